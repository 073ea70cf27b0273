"""Personal data by weak supervision, in DataFrame functions only (operator 7).

Candidates are the matches of fixed patterns: those that pass their check are
base spans and always stay; those that fail it, and looser forms (telephone
numbers without a plus, masked e-mail addresses), become spans only where the
method says so. Four labelers vote +1, -1 or 0 on every candidate: the pattern's
own check, gazetteers (domains, issuers, country and area codes), cue words in
the text before, and the characters around. Expectation-maximisation over the
counts of vote patterns estimates each labeler's reliability and a probability
for each pattern; these soft labels train a logistic span classifier on the votes
and on what the labelers don't look at (FEATURES: the span's length, digits and
separators and the characters on either side, each by kind), whose probability
decides about the candidates that are not base. Only counts by pattern come to
the driver; features are coarse, so there are some thousands at most, whatever
the number of documents.

Matches are found with possessive quantifiers and started only where a run
starts or the last match ended, so each pattern takes time linear in the text;
what stands before and after a match is taken from the parts between matches.

Defined results: a null or empty text has no spans; positions count code points;
rows with equal or null doc_id are treated each on its own; other columns are
kept by `redact` and ignored by `find`; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.llm.shared import cut, written

KINDS = ("email", "ip", "card", "phone")

# The base patterns, each started at a run's start or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOOSE_PHONE = r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"
MASKED_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}\x20?[\[(]dot[\])]\x20?[A-Za-z]{2,24}(?![A-Za-z0-9])"
OCTETS = r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?){3}$"

#: Pattern, its kind, its source, and what a text must have for it to be looked for.
PATTERNS = (
    ("m0", EMAIL, 0, "base", "contains(t, '@')"),
    ("m1", IP, 1, "base", "contains(t, '.') AND t RLIKE '[0-9][.][0-9]'"),
    ("m2", CARD, 2, "base", "t RLIKE '[0-9]([ -]?[0-9]){13}'"),
    ("m3", PHONE, 3, "base", "contains(t, '+')"),
    ("m4", LOOSE_PHONE, 3, "loose", "t RLIKE '[0-9]{3}[ .-][0-9]{4}'"),
    ("m5", MASKED_EMAIL, 0, "loose", "t RLIKE '[(\\\\[]at[)\\\\]]'"),
)

# Fixed values of the gazetteers and cue words.
DOMAINS = "com|org|net|edu|gov|info|io|eu|de|fr|es|it|uk|us|ca|nl|ch|at|br|mx|jp|cn|in|au"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|35|36|6011|62|64|65"
CALLING = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2}"
CUES = {0: "mail|contact|write to|reply", 1: "ip|host|server|address|client|login", 2: "card|visa|master|amex|payment|credit|konto|tarjeta|carte", 3: "phone|tel|call|mobile|fax|cell|whatsapp|telefon"}
AGAINST = "order|invoice|isbn|serial|version|sku|ticket|tracking|hash|checksum|article no|part no"

#: Code points of text before a candidate that are searched for cue words.
BEFORE = 40
#: Matches of which a prefix sum is taken at once.
RUN = 256
#: Code points of text that are masked at once.
CHUNK = 4096
VOTES = ("check", "gazetteer", "cue", "edge")
FEATURES = ("size", "digits", "marks", "lead", "tail")
NAMES = ("kind", *VOTES, *FEATURES)


def _found(name: str) -> str:
    """Start, text and surroundings of each match, from the matches v and the parts between them, p."""
    v, p = f"{name}_v", f"{name}_p"
    units = f"zip_with(slice({p}, 1, size({v})), {v}, (a, b) -> char_length(a) + char_length(b))"
    runs = f"transform(sequence(0, (size(z.u) - 1) DIV {RUN}), k -> aggregate(slice(z.u, k * {RUN} + 1, {RUN}), 0, (a, b) -> a + b))"
    return f"""transform(array(named_struct('u', {units})), z -> transform(array(named_struct('u', z.u, 'r',
        aggregate({runs}, named_struct('t', 0, 'a', CAST(array() AS array<int>)), (a, b) -> named_struct('t', a.t + b, 'a', concat(a.a, array(a.t)))).a)), w ->
        transform({v}, (x, i) -> named_struct('s', w.r[i DIV {RUN}] + aggregate(slice(w.u, (i DIV {RUN}) * {RUN} + 1, i % {RUN}), 0, (a, b) -> a + b) + char_length({p}[i]), 'v', x,
        'before', lower(right(concat(right(coalesce(get({v}, i - 1), ''), {BEFORE}), right({p}[i], {BEFORE})), {BEFORE})), 'after', left({p}[i + 1], 1))))[0])[0]"""


def _luhn(d: str) -> str:
    return f"""aggregate(sequence(1, char_length({d})), 0, (a, i) -> a + CASE WHEN (char_length({d}) - i) % 2 = 0 THEN int(substring({d}, i, 1))
        WHEN substring({d}, i, 1) >= '5' THEN 2 * int(substring({d}, i, 1)) - 9 ELSE 2 * int(substring({d}, i, 1)) END) % 10 = 0"""


def _candidate(name: str, kind: int, source: str) -> str:
    """Kind, place, text, digits and surroundings of each match."""
    return f"""transform({name}, x -> named_struct('kind', {kind}, 'loose', {str(source == "loose").lower()}, 's', x.s, 'e', x.s + char_length(x.v), 'v', x.v,
        'd', CASE WHEN {kind} IN (2, 3) THEN regexp_replace(x.v, '[^0-9]', '') ELSE '' END,
        'before', x.before, 'after', x.after))"""


def _passes() -> str:
    """Whether a candidate that matches a base pattern passes its check."""
    long_digits = "char_length(x.d)"
    return f"""CASE x.kind WHEN 0 THEN true WHEN 1 THEN x.v RLIKE '{OCTETS.replace(chr(92), chr(92) * 2)}'
        WHEN 2 THEN CASE WHEN {long_digits} BETWEEN 14 AND 19 THEN {_luhn("x.d")} ELSE false END
        ELSE {long_digits} BETWEEN 10 AND 15 END"""


def _votes() -> str:
    cue = " ".join(f"WHEN x.kind = {k} AND x.before RLIKE '(^|[^a-z])({words})' THEN 1" for k, words in CUES.items())
    return f"""named_struct('kind', x.kind, 's', x.s, 'e', x.e, 'base', x.good AND NOT x.loose, 'votes', named_struct(
        'check', CASE WHEN x.loose THEN 0 WHEN x.good THEN 1 ELSE -1 END,
        'gazetteer', CASE
            WHEN x.kind = 0 THEN CASE WHEN lower(x.v) RLIKE '[.\\\\])\\\\x20]({DOMAINS})$' THEN 1 ELSE -1 END
            WHEN x.kind = 1 THEN CASE WHEN x.v RLIKE '^0*([1-9]|[1-9][0-9]|1[01][0-9]|12[0-68-9]|1[3-9][0-9]|2[01][0-9]|22[0-3])[.]' THEN 1 ELSE -1 END
            WHEN x.kind = 2 THEN CASE WHEN x.d RLIKE '^({ISSUERS})' THEN 1 ELSE -1 END
            WHEN x.loose THEN CASE WHEN x.d RLIKE '^[2-9][0-9]{{2}}[2-9]' THEN 1 ELSE -1 END
            ELSE CASE WHEN x.d RLIKE '^({CALLING})' THEN 1 ELSE -1 END END,
        'cue', CASE WHEN x.before RLIKE '({AGAINST})' THEN -1 {cue} ELSE 0 END,
        'edge', CASE WHEN x.before RLIKE '[\\\\p{{L}}\\\\p{{N}}]$' OR x.after RLIKE '[\\\\p{{L}}\\\\p{{N}}]' THEN -1 ELSE 1 END), 'features', {_features()})"""


def _features() -> str:
    """Buckets, ten numbers for each kind."""

    def bucket(x: str, bounds: tuple[int, ...]) -> str:
        return "CASE " + " ".join(f"WHEN {x} < {n} THEN {i}" for i, n in enumerate(bounds)) + f" ELSE {len(bounds)} END"

    parts = {
        "size": bucket("char_length(x.v)", (8, 12, 16, 24)),
        "digits": bucket("char_length(regexp_replace(x.v, '[^0-9]', ''))", (1, 10, 11, 14, 17, 20)),
        "marks": bucket("char_length(regexp_replace(x.v, '[0-9A-Za-z]', ''))", (1, 2, 3, 4)),
        "lead": "CASE WHEN x.before RLIKE '[:=] ?$' THEN 2 WHEN x.before RLIKE '(^|[ \\\\t\\\\n])$' THEN 0 WHEN x.before RLIKE '[\\\\p{L}\\\\p{N}]$' THEN 1 ELSE 3 END",
        "tail": "CASE WHEN x.after RLIKE '^([ \\\\t\\\\n]|$)' THEN 0 WHEN x.after RLIKE '[\\\\p{L}\\\\p{N}]' THEN 1 WHEN x.after RLIKE '[.,;:)]' THEN 2 ELSE 3 END",
    }
    return "named_struct(" + ", ".join(f"'{k}', 10 * x.kind + {v}" for k, v in parts.items()) + ")"



def with_candidates(docs: DataFrame) -> DataFrame:
    """`docs` and an array column `cands`: kind, s, e (code points, end exclusive), base and votes of each candidate.

    Card-like runs of fewer than 14 or more than 19 digits are no candidates. No
    other column of `docs` may bear the name of one made here (`redact` sees to that).
    """
    own = docs.columns
    df = docs.withColumn("t", F.coalesce(F.col("text"), F.lit("")))
    none = F.expr("CAST(array() AS array<string>)")
    for name, pattern, _, _, needs in PATTERNS:
        df = df.withColumn(f"{name}_v", F.when(F.expr(needs), F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(none))
    for name, pattern, _, _, _ in PATTERNS:
        df = df.withColumn(f"{name}_p", F.when(F.size(f"{name}_v") > 0, F.split("t", pattern, -1)).otherwise(none))
    for name, *_ in PATTERNS:
        df = df.withColumn(name, F.when(F.size(f"{name}_v") > 0, F.expr(_found(name))).otherwise(F.expr("CAST(array() AS array<struct<s:int, v:string, before:string, after:string>>)")))
    df = df.withColumn("raw", F.concat(*(F.expr(_candidate(name, kind, source)) for name, _, kind, source, _ in PATTERNS)))
    df = df.withColumn("raw", F.filter("raw", lambda x: (x["kind"] != 2) | F.length(x["d"]).between(14, 19)))
    fields = ", ".join(f"'{f}', x.{f}" for f in ("kind", "loose", "s", "e", "v", "d", "before", "after"))
    df = df.withColumn("raw", F.expr(f"transform(raw, x -> named_struct({fields}, 'good', {_passes()}))"))
    return df.withColumn("cands", F.expr(f"transform(raw, x -> {_votes()})")).select(*own, "cands")


@dataclass(frozen=True)
class Model:
    """Reliabilities by labeler, label and vote; the span classifier's bias and its weight of each feature value."""

    prior: float
    reliability: dict[tuple[str, int, int], float]
    bias: float
    weights: dict[tuple[str, int], float]


def _posterior(pattern: tuple, prior: float, table: dict) -> float:
    one, none = math.log(prior), math.log(1 - prior)
    for name, vote in zip(VOTES, pattern[1:], strict=True):
        one += math.log(table[name, 1, vote])
        none += math.log(table[name, 0, vote])
    return 1 / (1 + math.exp(max(-700.0, min(700.0, none - one))))


def em(counts: dict[tuple, int], rounds: int = 100) -> tuple[float, dict, dict[tuple, float]]:
    """Prior, reliabilities and the probability of each pattern (kind, votes...), from how often each occurs."""
    share = {p: 1 / (1 + math.exp(-1.5 * sum(p[1:]))) for p in counts}
    prior, table = 0.5, {}
    for _ in range(rounds):
        total = sum(counts.values())
        prior = min(1 - 1e-6, max(1e-6, (1 + sum(n * share[p] for p, n in counts.items())) / (2 + total)))
        for i, name in enumerate(VOTES):
            for label in (0, 1):
                mass = {v: 1.0 for v in (-1, 0, 1)}
                mass[2 * label - 1] += 1.0  # a labeler is taken to be better than chance before any evidence
                for p, n in counts.items():
                    mass[p[1 + i]] += n * (share[p] if label else 1 - share[p])
                for v, m in mass.items():
                    table[name, label, v] = m / sum(mass.values())
        new = {p: _posterior(p, prior, table) for p in counts}
        done = max((abs(new[p] - share[p]) for p in counts), default=0) < 1e-9
        share = new
        if done:
            break
    return prior, table, share


def train(counts: dict[tuple, int], share: dict[tuple, float], rounds: int = 400) -> tuple[float, dict]:
    """Logistic regression on a pattern's values (by NAMES), with the probabilities by kind and votes as soft labels, by gradient steps."""
    names = {x: i for i, x in enumerate(sorted({x for p in counts for x in zip(NAMES, p, strict=False)}))}
    if not names:
        return 0.0, {}
    at = np.array([[names[x] for x in zip(NAMES, p, strict=False)] for p in counts])
    n = np.array(list(counts.values()), float) / sum(counts.values())
    y = np.array([share[p[: 1 + len(VOTES)]] for p in counts])
    bias, weights = 0.0, np.zeros(len(names))
    for _ in range(rounds):
        miss = n * (y - 1 / (1 + np.exp(-np.clip(bias + weights[at].sum(axis=1), -700, 700))))
        bias += miss.sum()
        weights += np.bincount(at.ravel(), np.repeat(miss, at.shape[1]), len(names)) - 1e-5 * weights
    return float(bias), {x: float(weights[i]) for x, i in names.items()}


def fit(found: DataFrame) -> Model:
    """Learn from the candidates of all rows of `found` (cands); the driver gets one row for each pattern of votes and features."""
    each = found.select(F.explode("cands").alias("c")).select("c.kind", "c.votes.*", "c.features.*")
    counts = {tuple(x)[:-1]: x["count"] for x in sorted(each.groupBy(*NAMES).count().collect())}
    votes: dict[tuple, int] = {}
    for p, n in counts.items():
        votes[p[: 1 + len(VOTES)]] = votes.get(p[: 1 + len(VOTES)], 0) + n
    prior, table, share = em(votes)
    return Model(prior, table, *train(counts, share))


def _score(model: Model, x: Column) -> Column:
    z = F.lit(model.bias)
    for f in NAMES:
        values = {v: w for (g, v), w in model.weights.items() if g == f}
        at = x["kind"] if f == "kind" else x["votes" if f in VOTES else "features"][f]
        z = z + sum((F.when(at == v, F.lit(w)).otherwise(0.0) for v, w in sorted(values.items())), F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def with_spans(found: DataFrame, model: Model) -> DataFrame:
    """`base` and `spans`: arrays of (s, kind, e) by start, then kind; a span that the method adds overlaps no base span."""
    brief = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e")))
    df = found.withColumn("base", F.array_sort(brief(F.filter("cands", lambda x: x["base"]))))
    df = df.withColumn("added", F.when(F.exists("cands", lambda x: ~x["base"]), brief(F.filter("cands", lambda x: ~x["base"] & (_score(model, x) >= 0.5)))).otherwise(F.expr("CAST(array() AS array<struct<s:int, kind:int, e:int>>)")))
    df = df.withColumn("added", F.array_distinct(F.filter("added", lambda a: ~F.exists("base", lambda b: (a["s"] < b["e"]) & (b["s"] < a["e"])))))
    return df.withColumn("spans", F.array_sort(F.concat("base", "added"))).drop("cands", "added")


def _text_of(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(element_at(array({names}), x.kind + 1), ':', x.s, ':', x.e)), ',')"


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, base_sha256 and spans of every row of `docs` (doc_id, text, ...)."""
    found = cut(with_candidates(docs.select("doc_id", "text")).select("doc_id", "cands"))
    df = with_spans(found, fit(found))
    counts = [F.expr(f"CAST(size(filter(base, x -> x.kind = {k})) AS long)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return df.select("doc_id", *counts, F.sha2(F.expr(_text_of("base")), 256).alias("base_sha256"), F.expr(_text_of("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with each span of its text replaced by its kind in angle brackets; spans that overlap are masked as one, named after the first.

    Candidates are looked for once: rows and candidates are written to the shared folder.
    """
    # The caller's columns travel by number, so that none can meet a column made on the way.
    numbered = docs.toDF(*("text" if c.lower() == "text" else f"own{i}" for i, c in enumerate(docs.columns)))
    found = written(with_candidates(numbered), "pii")
    df = with_spans(found, fit(found))
    names = ", ".join(f"'<{k.upper()}>'" for k in KINDS)
    # Chunk by chunk, so that a long text with many spans isn't walked from its start for each of them.
    inside = f"filter(spans, x -> x.s >= c.at AND x.s < c.at + {CHUNK})"
    step = f"""CASE WHEN x.s < a.at THEN named_struct('at', greatest(a.at, x.e), 'out', a.out) ELSE
        named_struct('at', x.e, 'out', concat(a.out, array(substring(c.t, a.at - c.at + 1, x.s - a.at), element_at(array({names}), x.kind + 1)))) END"""
    masked = f"""array_join(transform(transform(regexp_extract_all(text, '(?s).{{1,{CHUNK}}}', 0), (t, i) -> named_struct('t', t, 'at', i * {CHUNK})), c ->
        transform(array(aggregate({inside}, named_struct('at', greatest(c.at, coalesce(array_max(transform(filter(spans, x -> x.s < c.at), x -> x.e)), 0)), 'out', CAST(array() AS array<string>)), (a, x) -> {step})),
        z -> concat(array_join(z.out, ''), CASE WHEN z.at < c.at + {CHUNK} THEN substring(c.t, z.at - c.at + 1) ELSE '' END))[0]), '')"""
    return df.withColumn("text", F.when(F.size("spans") > 0, F.expr(masked)).otherwise(F.col("text"))).select(*numbered.columns).toDF(*docs.columns)
