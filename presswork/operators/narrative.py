"""Sentences about a story's coverage, as columns of its lanes (see coverage.lanes), texts and timeline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of ownership models in sentences.
OWNERSHIP_NAMES = {
    "independent": "independent",
    "corporate": "corporate",
    "private-equity": "private equity",
    "state-funded": "state-funded",
    "telecom": "telecom",
    "government": "government",
    "non-profit": "non-profit",
    "other": "other",
}
# The sentences, with names for what they are filled with.
SENTENCES = {
    "heavy": "Coverage gap: the story is heavily {lane}-weighted, with only {a}% {x} coverage and {b}% {y} coverage.",
    "overview": "Coverage leans {dominant} overall: {left}% left, {center}% center, {right}% right.",
    "missing": "Coverage gap: {name} coverage is missing from the current source mix.",
    "thinnest": "Coverage gap: {name} is the thinnest lane at {thin}%, so it is worth checking additional sources from that perspective.",
    "no_gap": "No major coverage gap is visible: left, center, and right lanes are all represented in the current source mix.",
    "methodology": "This view combines {sources} sources across {n} active lane{s}. Blindspot flags trigger when one lane dominates coverage, and the timeline updates as new sources join the cluster.",
    "no_lead": "additional reporting context",
    "framing_delta": "Shared reporting centers on {c}. Left-leaning coverage emphasizes {l}, while right-leaning coverage emphasizes {r}.",
    "ownership_mix": "Ownership mix spans {n} model{s}: {listed}.",
    "no_ownership": "Ownership data is not available for this story yet.",
    "opened": "{f} opened coverage, and the story grew to {n} sources over {h} hours",
    "widened": ". The spectrum widened from {a} to {b}.",
    "stayed": " while staying within {b}.",
    "no_momentum": "Coverage momentum will become clearer as more sources join this story.",
}


def said(template: str, **parts: Column) -> Column:
    """A sentence with {names} in it filled from columns."""
    pieces, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        pieces += [F.lit(head), parts[name].cast("string")]
    return F.concat(*pieces, F.lit(rest))


def _shares(lane: Column) -> dict[str, Column]:
    return {k: lane[k] for k in ("left", "center", "right")}


def overview(lane: Column) -> Column:
    return said(SENTENCES["overview"], dominant=lane["dominant"], **_shares(lane))


def coverage_gap(lane: Column) -> Column:
    """A lane of 70 % or more, one that is missing, one under 15 %, or no gap; the thinnest is the first of left, center, right."""
    s = _shares(lane)
    thin = F.least(*s.values())
    name = F.when(s["left"] == thin, "left").when(s["center"] == thin, "center").otherwise("right")
    heavy = {k: said(SENTENCES["heavy"].replace("{lane}", k).replace("{x}", x).replace("{y}", y), a=s[x], b=s[y]) for k, (x, y) in {"left": ("center", "right"), "center": ("left", "right"), "right": ("left", "center")}.items()}
    top = F.greatest(*s.values()) >= 70
    return (
        F.when(top & (lane["dominant"] == "left"), heavy["left"])
        .when(top & (lane["dominant"] == "center"), heavy["center"])
        .when(top, heavy["right"])
        .when(thin == 0, said(SENTENCES["missing"], name=name))
        .when(thin < 15, said(SENTENCES["thinnest"], name=name, thin=thin))
        .otherwise(SENTENCES["no_gap"])
    )


def active_lanes(lane: Column) -> Column:
    return sum(((v > 0).cast("int") for v in _shares(lane).values()), F.lit(0))


def methodology(sources: Column, lane: Column) -> Column:
    n = active_lanes(lane)
    return said(SENTENCES["methodology"], sources=sources, n=n, s=F.when(n == 1, "").otherwise("s"))


def lead(text: Column) -> Column:
    """The first line of a bulleted text that says anything, without its bullet."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, "^[\u2022*-]\\s*", ""))), lambda x: x != "")
    return F.coalesce(F.get(lines, F.lit(0)), F.lit(SENTENCES["no_lead"]))


def framing_delta(common: Column, left: Column, right: Column) -> Column:
    return said(SENTENCES["framing_delta"], c=lead(common), l=lead(left), r=lead(right))


def ownership_mix(models: Column) -> Column:
    """From an array of (ownership, n) in the order in which they were met."""
    names = F.create_map(*[F.lit(x) for pair in OWNERSHIP_NAMES.items() for x in pair])
    parts = F.transform(models, lambda m: F.concat(F.try_element_at(names, m["ownership"]), F.lit(" ("), m["n"].cast("string"), F.lit(")")))
    n = F.size(models)
    listed = F.when(n == 1, F.get(parts, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.get(parts, n - 1)))
    some = said(SENTENCES["ownership_mix"], n=n, s=F.when(n == 1, "").otherwise("s"), listed=listed)
    return F.when(F.coalesce(n, F.lit(0)) > 0, some).otherwise(SENTENCES["no_ownership"])


def lane_spread(lane: Column, opening: bool) -> Column:
    active = F.filter(F.array(*[F.when(v > 0, F.lit(k)) for k, v in _shares(lane).items()]), lambda x: x.isNotNull())
    before = "" if opening else "include "
    one, two = F.concat(F.get(active, F.lit(0)), F.lit("-only coverage")), F.concat(F.lit(before), F.array_join(active, " and "), F.lit(" lanes"))
    return F.when(F.size(active) == 1, one).when(F.size(active) == 2, two).otherwise(before + "left, center, and right lanes")


def momentum(first_source: Column, sources: Column, hours: Column, opening: Column, latest: Column) -> Column:
    """How a timeline went on: first source, sources by now, hours, and the lanes at its ends; without events what to expect."""
    a, b = lane_spread(opening, True), lane_spread(latest, False)
    start = said(SENTENCES["opened"], f=first_source, n=sources, h=hours)
    told = F.when(a != b, F.concat(start, said(SENTENCES["widened"], a=a, b=b))).otherwise(F.concat(start, said(SENTENCES["stayed"], b=b)))
    return F.when(first_source.isNotNull(), told).otherwise(SENTENCES["no_momentum"])
