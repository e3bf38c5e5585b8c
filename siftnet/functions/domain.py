"""Scores of names as Column expressions: machine-made labels, tunnels, private reverse names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftnet.functions.net import let

# Suffixes of two labels.
MULTI_PART_TLDS = "co.uk co.jp co.kr co.nz co.za co.in com.au com.br com.cn com.mx com.tr com.sg org.uk net.au ac.uk gov.uk edu.au or.jp ne.jp ac.jp".split()
# Pairs of consonants that are common in words.
COMMON_PAIRS = "th ch sh ph wh ck nd ng nk nt st sk sp sc sm sn sl sw bl br cl cr dr fl fr gl gr pl pr tr tw wr gh gn kn mn ps rn rs rt rd rl rm rk rp rb rc rg rv lk lm ln lp lt ld lf lv ls ft mp mb ct pt xt".split()
DGA_THRESHOLD = 0.65
TUNNEL_THRESHOLD = 0.6


def labels(domain: Column) -> Column:
    return F.split(domain, r"\.", -1)


def suffix_labels(parts: Column) -> Column:
    """How many labels the public suffix has."""
    last_two = F.concat_ws(".", F.slice(parts, -2, 2))
    return F.when((F.size(parts) >= 3) & last_two.isin(MULTI_PART_TLDS), 2).otherwise(1)


def longest(parts: Column) -> Column:
    """The longest string by bytes, the first of equals."""
    return F.aggregate(parts, F.lit(""), lambda a, x: F.when(F.octet_length(x) > F.octet_length(a), x).otherwise(a))


def effective_label(domain: Column) -> Column:
    """The longest label before the suffix; a name of one label is itself."""
    return let(labels(domain), lambda p: F.when(F.size(p) < 2, domain).otherwise(longest(F.slice(p, F.lit(1), F.greatest(F.size(p) - suffix_labels(p), F.lit(1))))))


def characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def entropy(s: Column) -> Column:
    """Shannon entropy of the characters in bits, over the length in bytes."""

    def of(chars: Column) -> Column:
        share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.octet_length(s)
        return F.aggregate(F.array_sort(F.transform(F.array_distinct(chars), share)), F.lit(0.0), lambda a, p: a - p * F.log2(p))

    return F.when(F.length(s) > 0, let(characters(s), of)).otherwise(0.0)


def entropy_score(s: Column) -> Column:
    return let(entropy(s), lambda e: _entropy_part(s, e))


def _entropy_part(s: Column, e: Column) -> Column:
    """From 3.0 to 4.2 bits it rises from 0 to 1; short texts have none."""
    return F.when(F.octet_length(s) < 6, 0.0).when(e < 3.0, 0.0).when(e > 4.2, 1.0).otherwise((e - 3.0) / 1.2)


def bigram_score(s: Column) -> Column:
    """The share of unusual pairs: with a digit, or of two consonants that are rarely together; from 0.15 to 0.55 it rises from 0 to 1."""

    def of(n: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(s, i, F.lit(2)))
        odd = F.size(F.filter(pairs, lambda p: p.rlike("[0-9]") | (p.rlike("^[b-df-hj-np-tv-z]{2}$") & ~p.isin(COMMON_PAIRS))))
        return let(odd / (n - 1), lambda r: F.when(r < 0.15, 0.0).when(r > 0.55, 1.0).otherwise((r - 0.15) / 0.40))

    return F.when(F.length(s) < 2, 0.0).otherwise(let(F.length(s), of))


def dga(domain: Column) -> Column:
    """Struct of label, entropy, bigram and score of a name that may be machine-made."""

    def of(label: Column) -> Column:
        parts = F.struct(entropy(label).alias("e"), bigram_score(label).alias("b"))
        return let(parts, lambda x: F.struct(label.alias("label"), x["e"].alias("entropy"), x["b"].alias("bigram"), F.when(F.octet_length(label) < 4, 0.0).otherwise(0.6 * _entropy_part(label, x["e"]) + 0.4 * x["b"]).alias("score")))

    return let(effective_label(domain), of)


def sub_labels(domain: Column) -> Column:
    """The labels before the registered domain; null for names of fewer than three labels."""
    return let(labels(domain), lambda p: F.when(F.size(p) >= 3, F.slice(p, F.lit(1), F.size(p) - F.when((F.size(p) >= 4) & (suffix_labels(p) == 2), 3).otherwise(2))))


def tunnel(domain: Column) -> Column:
    """Struct of score and signals of a name that may carry data."""

    def of(p: Column) -> Column:
        most = F.array_max(F.transform(p, F.octet_length))
        total = F.aggregate(p, F.lit(0), lambda a, x: a + F.octet_length(x))
        encoded = F.get(F.filter(p, lambda x: (F.octet_length(x) >= 16) & x.rlike("^[A-Za-z0-9+/=]{16,}$")), F.lit(0))
        hexed = encoded.rlike("^[0-9a-f]{16,}$")
        hit = lambda score, name: F.struct(F.lit(score).alias("s"), F.lit(name).alias("n"))
        parts = [
            F.when(most > 50, hit(0.4, "very_long_label")).when(most > 30, hit(0.25, "long_label")),
            F.when(hexed, hit(0.35, "hex_encoded")).when(encoded.isNotNull(), hit(0.3, "base64_encoded")),
            F.when(F.size(p) > 4, hit(0.2, "deep_subdomain")),
            F.when(total > 100, hit(0.25, "high_total_length")).when(total > 60, hit(0.1, "moderate_total_length")),
            F.when((most >= 8) & (entropy(longest(p)) > 3.8), hit(0.15, "high_entropy_subdomain")),
        ]
        hits = F.array_compact(F.array(*parts))
        return let(hits, lambda h: F.struct(F.least(F.lit(1.0), F.aggregate(h, F.lit(0.0), lambda a, x: a + x["s"])).alias("score"), F.transform(h, lambda x: x["n"]).alias("signals")))

    none = F.struct(F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("signals"))
    return let(sub_labels(domain), lambda p: F.when(p.isNull() | (F.size(p) == 0), none).otherwise(of(p)))


def is_private_reverse(domain: Column) -> Column:
    """Reverse names of private IPv4 addresses."""
    octet = lambda i: F.regexp_extract(domain, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.in-addr\.arpa$", i)
    a, b = octet(4), octet(3)
    return F.coalesce((a == "10") | ((a == "172") & b.rlike("^(1[6-9]|2[0-9]|3[01])$")) | ((a == "192") & (b == "168")) | ((a == "169") & (b == "254")), F.lit(False))


def parent_suffixes(domain: Column) -> Column:
    """A name and its parents, the longest first."""
    return let(labels(domain), lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.concat_ws(".", F.slice(p, i, F.size(p)))))


# --- the same in SQL, of a column or expression `d` -------------------------------------------------------------------------------------

_TLDS = ", ".join(f"'{t}'" for t in MULTI_PART_TLDS)
_PAIRS = ", ".join(f"'{p}'" for p in COMMON_PAIRS)


def _longest_sql(parts: str) -> str:
    return f"coalesce(list_reduce(list_concat([''], {parts}), lambda a, x: case when strlen(x) > strlen(a) then x else a end), '')"


def label_sql(d: str) -> str:
    p = f"string_split({d}, '.')"
    tld = f"case when len({p}) >= 3 and array_to_string({p}[-2:], '.') in ({_TLDS}) then 2 else 1 end"
    return f"case when len({p}) < 2 then {d} else {_longest_sql(f'{p}[1:greatest(len({p}) - ({tld}), 1)]')} end"


def entropy_sql(s: str) -> str:
    chars = f"string_split({s}, '')"
    return f"case when length({s}) > 0 then coalesce(list_sum(list_transform(list_distinct({chars}), lambda c: -(len(list_filter({chars}, lambda x: x = c)) / strlen({s})) * log2(len(list_filter({chars}, lambda x: x = c)) / strlen({s})))), 0) else 0 end"


def bigram_sql(s: str) -> str:
    pairs = f"list_transform(range(1, length({s})), lambda i: substring({s}, i, 2))"
    odd = f"len(list_filter({pairs}, lambda p: regexp_matches(p, '[0-9]') or (regexp_full_match(p, '[b-df-hj-np-tv-z]{{2}}') and p not in ({_PAIRS}))))"
    r = f"({odd} / (length({s}) - 1.0::double))"
    return f"case when length({s}) < 2 then 0 when {r} < 0.15 then 0 when {r} > 0.55 then 1 else ({r} - 0.15::double) / 0.40::double end"


def tunnel_sql(d: str) -> str:
    """Struct of score and signals (as a text)."""
    p = f"string_split({d}, '.')"
    sub = f"{p}[1:len({p}) - case when len({p}) >= 4 and array_to_string({p}[-2:], '.') in ({_TLDS}) then 3 else 2 end]"
    most, total = f"list_max(list_transform({sub}, lambda x: strlen(x)))", f"list_sum(list_transform({sub}, lambda x: strlen(x)))"
    enc = f"list_filter({sub}, lambda x: strlen(x) >= 16 and regexp_full_match(x, '[A-Za-z0-9+/=]{{16,}}'))[1]"
    parts = [
        f"case when {most} > 50 then 0.4::double when {most} > 30 then 0.25::double else 0 end",
        f"case when regexp_full_match({enc}, '[0-9a-f]{{16,}}') then 0.35::double when {enc} is not null then 0.3::double else 0 end",
        f"case when len({sub}) > 4 then 0.2::double else 0 end",
        f"case when {total} > 100 then 0.25::double when {total} > 60 then 0.1::double else 0 end",
        f"case when {most} >= 8 and {entropy_sql(_longest_sql(sub))} > 3.8 then 0.15::double else 0 end",
    ]
    return f"case when len({p}) >= 3 then least(1.0::double, {' + '.join(parts)}) else 0 end"


def tunnel_signals_sql(d: str) -> str:
    """The signals of ``tunnel`` as a list."""
    p = f"string_split({d}, '.')"
    sub = f"{p}[1:len({p}) - case when len({p}) >= 4 and array_to_string({p}[-2:], '.') in ({_TLDS}) then 3 else 2 end]"
    most, total = f"list_max(list_transform({sub}, lambda x: strlen(x)))", f"list_sum(list_transform({sub}, lambda x: strlen(x)))"
    enc = f"list_filter({sub}, lambda x: strlen(x) >= 16 and regexp_full_match(x, '[A-Za-z0-9+/=]{{16,}}'))[1]"
    parts = [
        f"case when {most} > 50 then 'very_long_label' when {most} > 30 then 'long_label' end",
        f"case when regexp_full_match({enc}, '[0-9a-f]{{16,}}') then 'hex_encoded' when {enc} is not null then 'base64_encoded' end",
        f"case when len({sub}) > 4 then 'deep_subdomain' end",
        f"case when {total} > 100 then 'high_total_length' when {total} > 60 then 'moderate_total_length' end",
        f"case when {most} >= 8 and {entropy_sql(_longest_sql(sub))} > 3.8 then 'high_entropy_subdomain' end",
    ]
    return f"case when len({p}) >= 3 then list_filter([{', '.join(parts)}], lambda x: x is not null) else [] end"
