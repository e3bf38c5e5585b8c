"""Values that the registered queries give to operators, since the test tables have no such tables. No operator uses them."""

from __future__ import annotations

#: Names that stand for encrypted-DNS providers, beside the real ones, and addresses that stand for public resolvers.
SAMPLE_PROVIDERS = {"example.net": "Sample A", "gultur.example.com": "Sample B", "api.dasordio.test": "Sample C"}
SAMPLE_RESOLVERS = ("198.18.213.221", "198.19.208.1", "198.18.0.0", "198.18.5.135", "198.19.232.142")

#: Rules of a site: suppressions, newest last, and allowed patterns.
SUPPRESSIONS = [
    ("r1", "api.dasordio.test", None, [], True, 5), ("r2", None, "10.21.0.10", ["known_bad"], True, 4), ("r3", "bionbo.example", "10.20.0.1", [], True, 3),
    ("r4", "fiongus.example", None, ["beaconing", "known_bad"], True, 2), ("r5", None, None, ["firewall"], False, 1),
]
ALLOWED = [("w1", "*.example.net", None, None, True), ("w2", None, "10.20.*", "dga_candidate", True), ("w3", "edge-*", None, None, True), ("w4", "*", None, None, False)]
#: The same as a managed list: category, name and whether a rule is built in.
MANAGED = [("w1", "cdn", "net", True, True), ("w2", "local", "printers", False, True), ("w3", "cdn", "edge", False, True), ("w4", "all", "everything", True, False)]

#: Small tables of what devices are.
HOSTNAME_RULES = [(1, "-cam$|^cam-|camera", "camera", 0.8), (2, "-tv$|^tv-", "tv", 0.7), (3, "phone|mobile", "phone", 0.7), (4, "print|-prn", "printer", 0.8), (5, "nas", "storage", 0.6), (6, r"\.local$", "computer", 0.5)]
VENDOR_PREFIXES = [("0285", "Oluvo"), ("0221", "Brenta"), ("02BF", "Kestrin")]
VENDOR_TYPES = [("Oluvo", "camera"), ("Brenta", "router"), ("Kestrin", "thermostat"), ("Pellwik", "tv"), ("Madoro", "printer")]
SERVICES = [(554, "camera"), (9100, "printer"), (5353, "speaker"), (1900, "tv")]
OPTION_LISTS = [("22,80,443", "server", 0.7), ("53,80", "router", 0.6), ("554", "camera", 0.8)]
PROFILES = [("p1", ["Oluvo"], ["nealstu"], [554], "camera", 0.8), ("p2", ["Brenta"], [], [53, 8443], "router", 0.7), ("p3", [], [], [9100, 631], "printer", 0.75), ("p4", ["KESTRIN"], [], [], "thermostat", 0.6)]

#: Malware families whose names may occur among tags; domains whose subdomains are allowed.
FAMILIES = ["grelbot", "tinnet", "ombrel"]
ALLOWED_DOMAINS = ["example.net"]
