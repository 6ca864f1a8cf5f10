"""Text, title and URL columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..enums import REGION_KEYWORDS, TOPIC_KEYWORDS, TRACKING_PARAMS


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def fingerprint(title: Column) -> Column:
    """Lower-cased, everything but letters and digits to single spaces; accents are decomposed by `unaccented` first where wanted."""
    return squeezed(F.regexp_replace(F.lower(title), "[^a-z0-9\\s]", " "))


def unaccented(text: Column) -> Column:
    """Latin letters without accents, the usual two-letter forms of ligatures."""
    plain = F.translate(text, "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUY")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "ß", "ss"), "æ", "ae"), "œ", "oe")


def slug(label: Column, most: int = 100) -> Column:
    """Lower-case words joined by hyphens, at most so many characters, no hyphen at either end."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(s, 1, most), "-+$", "")


def source_slug(name: Column) -> Column:
    return slug(F.regexp_replace(name, "&", " and "), 10_000)


def embedding_text(title: Column, description: Column) -> Column:
    """What a vector is made of: title and description, or the title alone."""
    return F.when(F.coalesce(description, F.lit("")) != "", F.concat(title, F.lit(" \u2014 "), description)).otherwise(title)


def entity_id(uri: Column) -> Column:
    """The id at the end of a knowledge base's URI, null where there is none."""
    return F.nullif(F.regexp_extract(uri, "(Q[0-9]+)$", 1), F.lit(""))


def domain(url: Column) -> Column:
    """Host of a URL or domain: no protocol, www, port, path, query, fragment or trailing dots."""
    d = F.regexp_replace(F.lower(F.trim(url)), "^https?://", "")
    d = F.regexp_replace(F.regexp_replace(d, "^www\\.", ""), ":[0-9]+", "")
    return F.regexp_replace(F.regexp_extract(d, "^([^/?#]*)", 1), "\\.+$", "")


def canonical_url(url: Column) -> Column:
    """An article's URL: no fragment, host in lower case without amp., m. or mobile., no /amp, no tracking or empty parameters,
    keys in lower case and sorted (stable), no trailing slash. What is no http URL is trimmed only."""
    u = F.trim(url)
    parts = lambda i: F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?", i)
    host = F.regexp_replace(F.lower(parts(2)), "^(amp\\.|mobile\\.|m\\.)", "")
    protocol = F.lower(parts(1))
    host = F.when(protocol == "https", F.regexp_replace(host, ":443$", "")).otherwise(F.regexp_replace(host, ":80$", ""))
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(parts(3), "^/amp/", "/"), "/amp(?=/|$)", ""), "/{2,}", "/")
    path = F.when(path == "", "/").otherwise(path)
    pairs = F.transform(F.split(F.regexp_replace(F.coalesce(parts(4), F.lit("")), "^\\?", ""), "&"), lambda p: F.struct(F.lower(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), F.regexp_extract(p, "^([^=]*)", 1).alias("raw"), F.regexp_extract(p, "^[^=]*=(.*)$", 1).alias("v")))
    kept = F.filter(pairs, lambda p: ~p["raw"].isin(TRACKING_PARAMS) & (p["v"] != "") & (p["raw"] != ""))
    numbered = F.transform(kept, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v")))
    query_ = F.array_join(F.transform(F.array_sort(numbered), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    bare = F.when((path != "/") & (query_ == ""), F.regexp_replace(path, "/$", "")).otherwise(path)
    out = F.concat(protocol, F.lit("://"), host, bare, F.when(query_ != "", F.concat(F.lit("?"), query_)).otherwise(""))
    return F.when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), out).otherwise(u)


def plain_ipv4(host: Column) -> Column:
    """(address, bad): a host whose last part is a number in its dotted form, as URL parsers write it, null for names; bad where such a host is no address.

    Parts are decimal, octal (0...) or hexadecimal (0x...); the last of fewer
    than four stands for all bytes that are left.
    """
    parts = F.split(F.regexp_replace(host, "\\.$", ""), "\\.")
    n = F.size(parts)
    value = lambda p: F.when(p.rlike("^0x[0-9a-f]{0,15}$"), F.conv(F.concat(F.lit("0"), F.substring(p, 3, 15)), 16, 10)).when(p.rlike("^0[0-7]{0,20}$"), F.conv(p, 8, 10)).when(p.rlike("^[1-9][0-9]{0,17}$"), p).cast("double")
    values = F.transform(parts, value)
    last = F.element_at(values, -1)
    bytes_ = F.slice(values, 1, n - 1)
    good = (n <= 4) & ~F.exists(values, lambda v: v.isNull()) & ~F.exists(bytes_, lambda v: v > 255) & (last < F.pow(F.lit(256.0), 5 - n))
    number = F.aggregate(F.transform(bytes_, lambda v, i: v * F.pow(F.lit(256.0), 3 - i)), last, lambda a, v: a + v).cast("long")
    octets = [(F.shiftright(number, k) % 256).cast("string") for k in (24, 16, 8, 0)]
    numeric = F.element_at(parts, -1).rlike("^([0-9]+|0x[0-9a-f]*)$")
    return F.struct(F.when(numeric & good, F.concat_ws(".", *octets)).alias("address"), (numeric & ~F.coalesce(good, F.lit(False))).alias("bad"))


def is_public_url(url: Column) -> Column:
    """http or https to a host that is neither local nor in a private range, whatever form an IPv4 address is written in."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z]+://(?:[^@/?#]*@)?(\\[[^\\]]*\\]|[^:/?#]*)", 1)), "^\\[|\\]$", "")
    pair = [F.conv(F.regexp_extract(host, "^::ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$", k), 16, 10).cast("int") for k in (1, 2)]
    octets = [F.floor(x / d) % 256 for x in pair for d in (256, 1)]
    plain = plain_ipv4(F.regexp_replace(host, "^::ffff:", ""))
    v4 = F.when(host.rlike("^::ffff:[0-9a-f]{1,4}:[0-9a-f]{1,4}$"), F.concat_ws(".", *[o.cast("string") for o in octets])).otherwise(F.coalesce(plain["address"], F.lit("")))
    private = v4.rlike("^(0|10|127)\\.|^169\\.254\\.|^192\\.168\\.|^172\\.(1[6-9]|2[0-9]|3[01])\\.|^100\\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\\.")
    v6 = host.rlike("^(::1?$|f[cd]|fe[89ab])") & host.contains(":")
    named = host.isin("localhost", "metadata.google.internal") | host.rlike("\\.(local|internal|localhost)$")
    bad = plain["bad"] & ~host.contains(":")
    return url.rlike("^https?://") & (host != "") & ~(private | v6 | named | bad)


def classified(text: Column, groups: dict[str, list[str]], default: str, boundaries: bool) -> Column:
    """The first group with a keyword in the text: single words at word boundaries (if asked), phrases anywhere."""
    t = F.lower(text) if boundaries else F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    out = F.lit(default)
    for name, words in reversed(groups.items()):
        single = [re.escape(w) for w in words if " " not in w or not boundaries]
        phrases = [re.escape(w) for w in words if " " in w and boundaries]
        pattern = "|".join(([f"(?<![a-z0-9_])(?:{'|'.join(single)})(?![a-z0-9_])"] if boundaries else single) + phrases)
        out = F.when(t.rlike(pattern.replace("\\ ", " ")), name).otherwise(out)
    return out


def topic_of(text: Column) -> Column:
    return classified(text, TOPIC_KEYWORDS, "politics", True)


def region_of(text: Column) -> Column:
    return classified(text, REGION_KEYWORDS, "us", False)


def terms(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def parse_search(search: str) -> list[tuple[bool, list[list[str]]]]:
    """A web search as clauses that must all hold: (negated, alternatives), an alternative being a run of words.

    Quotes make phrases, a minus negates, `or` between two parts makes them alternatives.
    """
    parts = re.findall(r'-?"[^"]*"|\S+', search)
    out: list[tuple[bool, list[list[str]]]] = []
    join = False
    for p in parts:
        if p.lower() == "or":
            join = bool(out)
            continue
        negated = p.startswith("-")
        words = re.findall(r"[a-z0-9]+", p.lower())
        if not words:
            continue
        if join and out and not negated and not out[-1][0]:
            out[-1][1].append(words)
        else:
            out.append((negated, [words]))
        join = False
    return out


def matches(text: Column, search: str) -> Column:
    """Whether a text meets a web search; words are compared as they are, without stems."""
    padded = F.concat(F.lit(" "), F.array_join(terms(F.coalesce(text, F.lit(""))), " "), F.lit(" "))
    out = F.lit(True)
    for negated, alternatives in parse_search(search):
        any_ = F.lit(False)
        for words in alternatives:
            any_ = any_ | padded.contains(f" {' '.join(words)} ")
        out = out & (~any_ if negated else any_)
    return out


def like_escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def embedding_text(title: Column, description: Column) -> Column:
    """What an article's embedding is made of: its title and, if it has one, its description."""
    return F.concat_ws(" \u2014 ", title, F.when(description != "", description))
