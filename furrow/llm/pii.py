"""Personal data in whole texts by weak supervision, as DataFrame expressions only.

Patterns find base spans (email, ip, card, phone) and further candidates. Labelers
vote on each candidate: its pattern's strictness, a gazetteer of words that stand before
such data, and the context around it. Votes are counted per combination of votes - a
bounded table, whatever the corpus - and expectation-maximisation on these counts
estimates how reliable each labeler is. The posterior then trains a logistic span
classifier on features of the span itself, again on counts per feature combination;
that classifier decides which candidates become spans. Base spans always stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from furrow.functions.paths import let

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]

# The four base patterns, written with possessive groups so that long
# texts need neither a deep stack nor repeated attempts inside one run. \G lets a match
# begin where the last one ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A run of digits and single separators, of the 14 digits a card needs at least.
    "card": r"[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# A quick test that a text can hold the kind at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}", "phone": r"\+[0-9]"}
# Candidates beyond the base patterns: values after a naming word, key-like tokens, and
# numbers written like a phone number without its plus sign.
CANDIDATES = {
    "secret": r"(?<![A-Za-z0-9_])(?:[A-Za-z_]{3,20}[ ]?[=:][ ]?\"?[A-Za-z0-9+/_-]{16,64}+|[A-Z]{4}[A-Z0-9]{12,24}+)(?![A-Za-z0-9+/_-])",
    "phone": r"(?<![0-9A-Za-z+.])(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
}
CANDIDATE_HINTS = {"secret": r"[=:][ ]?\"?[A-Za-z0-9+/_-]{16}|[A-Z]{4}[A-Z0-9]{12}", "phone": r"[0-9]{3}[ .-][0-9]{4}"}
# Words that name such data.
GAZETTEER = r"(?i)(?:password|passwd|pwd|token|secret|apikey|api_key|access_key|auth|credential|akia|phone|tel|mobile|fax|call)"
CONTEXT = 24
# Spans are gathered and texts are cut in pieces of so many, so that work per span does not follow their number.
CHUNK = 256
BLOCK = 1024
LABELERS = ("strict", "gazetteer", "context", "shape")
FEATURES = ("digits", "mixed", "assigned", "long", "named")
EM_ROUNDS = 50
FIT_ROUNDS = 2000


_SPAN = "struct<kind:string,start:int,end:int,value:string,before:string,after:string>"


def _scanned(size: Column, zero: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """Items of a scan over 0..size-1 as an array; `step(state, i)` gives the next state `s` and an `item` of type `kind`.

    Items are gathered in chunks, so that one more does not copy all before it.
    """
    none = F.array().cast(f"array<{kind}>")

    def chunk(held: Column, c: Column) -> Column:
        def one(inner: Column, i: Column) -> Column:
            return let(step(inner["s"], i), lambda n: F.struct(n["s"].alias("s"), F.concat(inner["out"], F.array(n["item"])).alias("out")))

        places = F.sequence(c * CHUNK, F.least(c * CHUNK + CHUNK, size) - 1)
        found = F.aggregate(places, F.struct(held["s"].alias("s"), none.alias("out")), one)
        return let(found, lambda x: F.struct(x["s"].alias("s"), F.concat(held["out"], F.array(x["out"])).alias("out")))

    start = F.struct(zero.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    chunks = F.sequence(F.lit(0), ((size - 1) / CHUNK).cast("int"))
    return F.when(size == 0, none).otherwise(F.aggregate(chunks, start, chunk, lambda held: F.flatten(held["out"])))


def _last(text: Column) -> Column:
    return F.right(text, F.lit(CONTEXT))


def _spans(kind: str, pattern: str, hint: str, text: Column) -> Column:
    """Array of (kind, start, end, value) in code points, leftmost and non-overlapping, with the text just before and the character after.

    Places and contexts come from the pieces between matches, each looked at once.
    """
    quiet = ~F.contains(text, F.lit(hint)) if hint == "@" else ~text.rlike(hint)
    none = F.array().cast(f"array<{_SPAN}>")
    cut = F.struct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))

    def placed(cut: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            gap, hit, rest = F.get(cut["gaps"], i), F.get(cut["found"], i), F.get(cut["gaps"], i + 1)
            after = F.when(rest != "", F.left(rest, F.lit(1))).otherwise(F.left(F.coalesce(F.get(cut["found"], i + 1), F.lit("")), F.lit(1)))
            start, before = state["at"] + F.char_length(gap), _last(F.concat(state["tail"], _last(gap)))
            span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.char_length(hit)).alias("end"), hit.alias("value"), before.alias("before"), after.alias("after"))
            tail = lambda v: _last(F.concat(v["before"], _last(v["value"])))
            return let(span, lambda v: F.struct(F.struct(v["end"].alias("at"), tail(v).alias("tail")).alias("s"), v.alias("item")))

        return _scanned(F.size(cut["found"]), zero, _SPAN, step)

    return F.when(quiet, none).otherwise(let(cut, placed))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(span: Column) -> Column:
    """The tests of the base kinds beyond their pattern."""
    digits = _digits(span["value"])
    card = F.length(digits).between(14, 19) & _luhn(digits)
    octet = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    ip = span["value"].rlike(rf"^{octet}(?:\.{octet}){{3}}$")
    phone = F.length(digits).between(10, 15)
    return F.when(span["kind"] == "email", True).when(span["kind"] == "ip", ip).when(span["kind"] == "card", card).otherwise(phone)


def _fenced(spans: Column) -> Column:
    """Spans in chunks with the least start and the largest end of each."""

    def fence(c: Column) -> Column:
        start, end = (lambda part, name=name: F.transform(part, lambda s: s[name]) for name in ("start", "end"))
        return let(F.slice(spans, c * CHUNK + 1, CHUNK), lambda part: F.struct(F.array_min(start(part)).alias("low"), F.array_max(end(part)).alias("high"), part.alias("spans")))

    return F.transform(F.sequence(F.lit(0), F.greatest(((F.size(spans) - 1) / CHUNK).cast("int"), F.lit(0))), fence)


def _apart(span: Column, fences: Column) -> Column:
    meets = lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"])
    return ~F.exists(fences, lambda f: F.coalesce((f["low"] < span["end"]) & (span["start"] < f["high"]), F.lit(False)) & F.exists(f["spans"], meets))


def _found(docs: DataFrame) -> DataFrame:
    """Adds `base`, the valid base spans, and `candidates`: base matches and others, each with votes and features."""
    text = F.coalesce(F.col("text"), F.lit(""))
    matched = F.concat(*(_spans(k, PATTERNS[k], HINTS[k], text) for k in BASE_KINDS))
    docs = docs.withColumn("matched", F.transform(matched, lambda s: s.withField("valid", _valid(s))))
    docs = docs.withColumn("base", F.filter("matched", lambda s: s["valid"]))
    others = F.concat(*(_spans(k, CANDIDATES[k], CANDIDATE_HINTS[k], text) for k in CANDIDATES))
    free = lambda spans: let(_fenced(F.col("base")), lambda fences: F.filter(spans, lambda s: _apart(s, fences)))
    others = let(others, lambda spans: F.when((F.size(spans) == 0) | (F.size("base") == 0), spans).otherwise(free(spans)))
    judged = lambda spans, base: F.transform(spans, lambda s: _judged(s, base))
    return docs.withColumn("others", judged(others, False)).withColumn("candidates", F.concat(judged(F.col("matched"), True), F.col("others")))


def _judged(span: Column, base: bool) -> Column:
    """A span with the labelers' votes (1 for, -1 against, 0 none) and the classifier's features (0 or 1)."""
    value, size = span["value"], F.char_length(span["value"])
    before, after = span["before"], span["after"]
    digits, letters = F.length(_digits(value)), F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    key = F.regexp_extract(value, "([A-Za-z0-9+/_-]+)$", 1)
    mixed = key.rlike("[0-9]") & key.rlike("[A-Za-z]")
    named = value.rlike(GAZETTEER) | before.rlike(GAZETTEER)
    yes = lambda c: F.when(c, 1).otherwise(0)
    vote = lambda good, bad: F.when(good, 1).when(bad, -1).otherwise(0)
    strict = F.when(span["valid"], 1).otherwise(-1) if base else vote((span["kind"] == "secret") & mixed & (F.length(key) >= 16), (span["kind"] == "secret") & ~mixed)
    edges = (before == "") | before.rlike("[\\s\"'(<\\[=:,;]$")
    context = vote(edges & ((after == "") | after.rlike("[^A-Za-z0-9]")), before.rlike("[A-Za-z0-9]$") | after.rlike("[A-Za-z0-9]"))
    shape = vote(F.when(span["kind"] == "secret", mixed).otherwise(digits >= 4) | (span["kind"] == "email"), digits + letters < 8)
    anchor = strict if base else F.lit(0)
    votes = F.struct(anchor.alias("anchor"), strict.alias("strict"), yes(named).alias("gazetteer"), context.alias("context"), shape.alias("shape"))
    features = F.struct(
        yes(2 * digits > size).alias("digits"), yes(mixed).alias("mixed"), yes(value.rlike("[=:]")).alias("assigned"), yes(size >= 16).alias("long"), yes(named).alias("named")
    )
    return F.struct(span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end"), votes.alias("votes"), features.alias("features"))


class SpanModel:
    """Reliabilities of the labelers and weights of the span classifier."""

    def __init__(self, reliability: dict[str, dict[int, tuple[float, float]]], prior: float, weights: dict[str, float]):
        self.reliability, self.prior, self.weights = reliability, prior, weights

    def accepts(self, candidate: Column) -> Column:
        score = F.lit(self.weights["one"]) + F.when(candidate["kind"] == "secret", self.weights["secret"]).otherwise(0.0)
        return score + sum((candidate["features"][f] * F.lit(self.weights[f]) for f in FEATURES), F.lit(0.0)) >= 0


def _reliabilities(rows: list[Row]) -> tuple[dict, float, list[float]]:
    """Expectation-maximisation over vote combinations with their counts; starts from the majority of votes.

    Base matches are anchors: those that pass their kind's tests are personal data, the
    others are not, so the estimated classes keep their meaning.
    """
    votes = [tuple(r[f] for f in LABELERS) for r in rows]
    anchored = [{1: 0.98, -1: 0.02, 0: None}[r.anchor] for r in rows]
    share = [a if a is not None else 0.9 if sum(v) > 0 else 0.1 for a, v in zip(anchored, votes)]
    table, prior = {}, 0.5
    for _ in range(EM_ROUNDS):
        mass = sum(r["n"] for r in rows)
        prior = (sum(p * r["n"] for p, r in zip(share, rows)) + 1) / (mass + 2)
        table = {}
        for i, name in enumerate(LABELERS):
            table[name] = {}
            for value in (-1, 0, 1):
                good = sum(p * r["n"] for p, r, v in zip(share, rows, votes) if v[i] == value) + 1
                bad = sum((1 - p) * r["n"] for p, r, v in zip(share, rows, votes) if v[i] == value) + 1
                table[name][value] = (good / (prior * mass + 3), bad / ((1 - prior) * mass + 3))
        share = []
        for a, v in zip(anchored, votes):
            if a is not None:
                share.append(a)
                continue
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[name][x][0] / table[name][x][1]) for name, x in zip(LABELERS, v))
            share.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return table, prior, share


def _classifier(rows: list[Row], share: list[float]) -> dict[str, float]:
    """Logistic regression on feature combinations, weighted by count, with the posterior as label."""
    names = ("one", "secret", *FEATURES)
    mass = sum(r["n"] for r in rows) or 1
    weights = dict.fromkeys(names, 0.0)
    inputs = [{"one": 1.0, "secret": float(r["kind"] == "secret"), **{f: float(r[f"f_{f}"]) for f in FEATURES}} for r in rows]
    for _ in range(FIT_ROUNDS):
        slope = dict.fromkeys(names, 0.0)
        for x, p, r in zip(inputs, share, rows):
            z = sum(weights[k] * x[k] for k in names)
            error = (p - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) * r["n"] / mass
            for k in names:
                slope[k] += error * x[k]
        for k in names:
            weights[k] += 2.0 * slope[k] - 0.0005 * weights[k]
    return weights


def fit(docs: DataFrame) -> SpanModel:
    """Labeler reliabilities and the span classifier from all texts of `docs`.

    The driver gets one count per kind, votes and features: at most 5 * 162 * 32 rows.
    Without candidates the classifier accepts nothing.
    """
    found = _found(docs.select(F.col("text").cast("string").alias("text"))).select(F.explode("candidates").alias("c"))
    counts = found.groupBy("c.kind", *(F.col(f"c.votes.{v}").alias(v) for v in ("anchor", *LABELERS)), *(F.col(f"c.features.{f}").alias(f"f_{f}") for f in FEATURES)).agg(F.count(F.lit(1)).alias("n"))
    rows = sorted(counts.collect())
    if not rows:
        return SpanModel({}, 0.5, dict.fromkeys(("secret", *FEATURES), 0.0) | {"one": -1.0})
    table, prior, share = _reliabilities(rows)
    return SpanModel(table, prior, _classifier(rows, share))


def find_spans(docs: DataFrame, model: SpanModel) -> DataFrame:
    """`docs` with `pii`: its spans (start, rank of the kind, end, kind) in order, base ones and those the model accepts.

    Starts and ends count code points, the end exclusive. A null or empty text has no
    spans. All rows and columns stay, repeated rows included, except that columns called
    matched, base, others, candidates or pii are replaced.
    """
    found = _found(docs)
    more = F.filter("others", model.accepts)
    rank = lambda s: F.array_position(F.lit(list(KINDS)), s["kind"]).cast("int")
    listed = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    found = found.withColumn("base", F.sort_array(listed(F.col("base"))))
    return found.withColumn("pii", F.sort_array(F.concat("base", listed(more)))).drop("matched", "others", "candidates")


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _part(blocks: Column, start: Column, end: Column) -> Column:
    """The characters start..end of a text in blocks of `BLOCK`, without a walk from its beginning."""
    first, last = (start / BLOCK).cast("int"), (end / BLOCK).cast("int")
    block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
    within = F.substring(block(first), start % BLOCK + 1, end - start)
    over = F.concat(F.substring(block(first), start % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), F.substring(block(last), F.lit(1), end % BLOCK))
    return F.when(first == last, within).otherwise(over)


def redact(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """`docs` with each span of `text` replaced by its kind in angle brackets; overlapping spans give one mark.

    Null texts stay null. Columns and rows stay as they are otherwise, whatever the
    columns are called.
    """
    columns = docs.columns
    # The row travels in one column, so its columns cannot clash with those of the search.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "text")
    spans = find_spans(whole, model or fit(docs))
    text = F.col("text")

    def marked(held: Column) -> Column:
        def step(at: Column, i: Column) -> Column:
            def piece(s: Column) -> Column:
                mark = F.concat(_part(held["blocks"], at, s["start"]), F.lit("<"), s["kind"], F.lit(">"))
                return F.struct(F.greatest(at, s["end"]).alias("s"), F.when(s["start"] >= at, mark).otherwise(F.lit("")).alias("item"))

            return let(F.get(held["pii"], i), piece)

        pieces = _scanned(F.size(held["pii"]), F.lit(0), "string", step)
        end = F.array_max(F.transform(held["pii"], lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), _part(held["blocks"], end, F.char_length(text)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    clean = let(F.struct(F.col("pii").alias("pii"), blocks.alias("blocks")), marked)
    changed = F.when(F.size("pii") > 0, clean).otherwise(text)
    return spans.select(*[changed.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns])
