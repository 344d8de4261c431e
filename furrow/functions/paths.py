"""Column functions on slash-separated paths."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it any number of times in `body`."""
    # element_at keeps its type; `get` would derive it from the whole body for every row.
    return F.element_at(F.transform(F.array(value), body), F.lit(1))


def normalize_separators(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def strip_trailing_slashes(path: Column) -> Column:
    return F.rtrim(path, F.lit("/"))


def normalize_prefix(path: Column) -> Column:
    return strip_trailing_slashes(normalize_separators(path))


def components(path: Column) -> Column:
    """Sort key that orders paths part by part instead of character by character."""
    return F.split(path, "/")


def tidy(path: Column) -> Column:
    """Canonical form: no empty or '.' parts, no trailing slash, '.' when nothing is left."""

    def join(p: Column) -> Column:
        parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
        root = F.when(p.rlike("^//(?!/)"), F.lit("//")).when(p.startswith("/"), F.lit("/")).otherwise(F.lit(""))
        return F.concat(root, F.array_join(parts, "/"))

    def tidied(p: Column) -> Column:
        probe = F.concat(p, F.lit("/"))
        done = ~(probe.contains("//") | probe.contains("/./") | probe.startswith("./") | (p == ""))
        return F.when(done, p).otherwise(let(join(p), lambda whole: F.when(whole == "", F.lit(".")).otherwise(whole)))

    return let(path, tidied)


def parent(path: Column) -> Column:
    """Parent of a tidy path; a root is its own parent and a bare name has parent '.'."""
    return let(
        path,
        lambda p: F.when(p.isin("/", "//", "."), p)
        .when(~p.contains("/"), F.lit("."))
        .otherwise(F.regexp_extract(p, "^(//?(?=[^/]*$)|.*(?=/))", 1)),
    )


def base_name(path: Column) -> Column:
    return let(path, lambda p: F.when(p == ".", F.lit("")).otherwise(F.substring_index(p, "/", -1)))


def child(directory: Column, name: Column) -> Column:
    return F.concat_ws("/", strip_trailing_slashes(directory), name)


def rule_array(pairs: Sequence[tuple[str, str]]) -> Column:
    """Literal rules, tried in the given order, as array<struct<old,new>>."""
    if not pairs:
        return F.from_json(F.lit("[]"), "array<struct<old:string,new:string>>")
    return F.array(*[F.struct(F.lit(o).alias("old"), F.lit(n).alias("new")) for o, n in pairs])


def clean_rules(rules: Column) -> Column:
    """Normalised rules with `lead` = old + '/'; an empty old prefix can match nothing."""
    tidy_rules = F.transform(
        rules,
        lambda r: let(
            normalize_prefix(r["old"]),
            lambda old: F.named_struct(
                F.lit("old"), old, F.lit("new"), normalize_prefix(r["new"]), F.lit("lead"), F.concat(old, F.lit("/"))
            ),
        ),
    )
    return F.filter(tidy_rules, lambda r: r["old"] != "")


def longest_first(rules: Column) -> Column:
    """Order by raw prefix length, longest first; equal lengths keep their order."""
    numbered = F.transform(
        rules,
        lambda r, i: F.struct(
            (-F.length(r["old"])).alias("neg"), i.alias("ord"), r["old"].alias("old"), r["new"].alias("new")
        ),
    )
    return F.transform(
        F.array_sort(numbered), lambda r: F.struct(r["old"].alias("old"), r["new"].alias("new"))
    )


def apply_rule(text: Column, old: Column, new: Column) -> Column:
    """Put `new` in place of the matching prefix `old`; a null `old` keeps the text as it came."""

    def replaced(normal: Column) -> Column:
        size = F.length(old)
        return (
            F.when(normal == old, new)
            .when(new == "", F.substring(normal, size + 2, F.length(normal)))
            .otherwise(F.concat(new, F.substring(normal, size + 1, F.length(normal))))
        )

    return F.when(old.isNull(), text).otherwise(let(normalize_separators(text), replaced))


def first_match(text: Column, rules: Column) -> Column:
    """The first of the cleaned rules that fits the text, as a struct, or null.

    With a slash behind both, equality and a match at a part boundary are one test.
    """
    return let(
        F.concat(normalize_separators(text), F.lit("/")),
        lambda probe: F.get(F.filter(rules, lambda r: probe.startswith(r["lead"])), F.lit(0)),
    )


def rewrite_cleaned(text: Column, rules: Column) -> Column:
    """Rewrite by rules that went through `clean_rules` already."""
    return let(first_match(text, rules), lambda hit: apply_rule(text, hit["old"], hit["new"]))


def rewrite_prefix(text: Column, rules: Column) -> Column:
    """First matching rule of a per-row rule array, matched at part boundaries."""
    return let(clean_rules(rules), lambda cleaned: rewrite_cleaned(text, cleaned))


def rewrite_with(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """The same for rules known when the plan is built: plain conditions that compile with the stage."""
    normal = normalize_separators(text)
    probe = F.concat(normal, F.lit("/"))
    result = F.when(F.lit(False), text)
    for old, new in ((o.replace("\\", "/").rstrip("/"), n.replace("\\", "/").rstrip("/")) for o, n in pairs):
        if old:
            rest = F.substring(normal, F.lit(len(old) + (1 if new else 2)), F.length(normal))
            result = result.when(probe.startswith(old + "/"), F.concat(F.lit(new), rest))
    return result.otherwise(text)


# One JSON text in pieces: a string with an optional key colon, or a run without quotes.
_JSON_PIECE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?+|[^"]++'


def _quoted(value: Column) -> Column:
    """A text as a JSON string."""
    return let(F.to_json(F.array(value)), lambda boxed: F.substring(boxed, F.lit(2), F.length(boxed) - 2))


def map_json_strings(document: Column, change: Callable[[Column], Column]) -> Column:
    """Apply `change` to every string value of a valid JSON text, at any depth.

    Keys, numbers, layout and untouched strings keep their exact characters.
    """

    def changed_piece(token: Column) -> Column:
        bare = F.substring(token, F.lit(2), F.length(token) - 2)
        escaped = F.get_json_object(F.concat(F.lit("["), token, F.lit("]")), "$[0]")
        text = F.when(token.contains("\\"), escaped).otherwise(bare)
        return let(
            text,
            lambda old: let(change(old), lambda new: F.when(new == old, token).otherwise(_quoted(new))),
        )

    def piece(token: Column) -> Column:
        is_value = token.startswith('"') & ~token.endswith(":")
        return F.when(is_value, changed_piece(token)).otherwise(token)

    pieces = F.regexp_extract_all(document, F.lit(_JSON_PIECE), F.lit(0))
    return F.array_join(F.transform(pieces, piece), "")


# Characters that no valid JSON text holds as such; they stand for an escaped backslash, an escaped quote and the quote before a string to look at.
_BACKSLASH, _QUOTE, _MARK = "\x01", "\x02", "\x03"
# First characters of a rule that also stand behind a closing quote, or are taken.
_AMBIGUOUS = (",", ":", "]", "}", " ", "\t", "\n", "\r", _BACKSLASH, _QUOTE, _MARK)


def rewrite_json_strings(document: Column, rules: Column) -> Column:
    """`map_json_strings` with `rewrite_cleaned`: only strings that begin like one of the rules are taken out of the text.

    Plain replacements mark these, so the rest of the document is not cut into pieces.
    """
    starts = F.array_distinct(F.transform(rules, lambda r: F.left(r["old"], F.lit(1))))

    def as_written(new: Column) -> Column:
        boxed = _quoted(new)
        return F.when(new.rlike(r'[\x00-\x1f"\\]'), F.substring(boxed, F.lit(2), F.length(boxed) - 2)).otherwise(new)

    # The rules in the terms of the marked text; `after` is where a text behind the old prefix goes on.
    ready = F.transform(
        rules,
        lambda r: F.named_struct(
            F.lit("lead"), F.replace(r["lead"], F.lit('"'), F.lit(_QUOTE)), F.lit("new"), as_written(r["new"]),
            F.lit("after"), F.length(r["old"]) + F.when(r["new"] == "", 2).otherwise(1),
        ),
    )

    def is_key(rest: Column) -> Column:
        space = " \t\n\x0b\f\r"
        return F.when(F.left(rest, F.lit(1)).isin(*space), F.ltrim(rest, F.lit(space)).startswith(":")).otherwise(rest.startswith(":"))

    def rewritten(part: Column, ready: Column) -> Column:
        """What stands behind a mark: the string, its closing quote and the text up to the next mark."""
        same = F.concat(F.lit('"'), part)

        def unless_key(inside: Column, changed: Callable[[Column], Column]) -> Column:
            return let(F.substring(part, F.length(inside) + 2, F.length(part)), lambda rest: F.when(is_key(rest), same).otherwise(changed(rest)))

        def with_escapes(inside: Column) -> Column:
            escaped = F.replace(F.replace(inside, F.lit(_BACKSLASH), F.lit("\\\\")), F.lit(_QUOTE), F.lit('\\"'))
            text = F.get_json_object(F.concat(F.lit('["'), escaped, F.lit('"]')), "$[0]")
            put = lambda old, new: F.when(new == old, same).otherwise(unless_key(inside, lambda rest: F.concat(_quoted(new), rest)))
            return let(text, lambda old: let(rewrite_cleaned(old, rules), lambda new: put(old, new)))

        def plain(inside: Column) -> Column:
            def put(probe: Column, hit: Column) -> Column:
                value = F.concat(F.lit('"'), hit["new"], F.substring(probe, hit["after"], F.length(probe) - hit["after"]), F.lit('"'))
                changed = lambda rest: F.concat(F.coalesce(value, F.lit("null")), rest)
                return F.when(hit.isNull(), same).otherwise(unless_key(inside, changed))

            probe = F.concat(F.replace(inside, F.lit(_BACKSLASH), F.lit("/")), F.lit("/"))
            return let(probe, lambda p: let(F.get(F.filter(ready, lambda r: p.startswith(r["lead"])), F.lit(0)), lambda hit: put(p, hit)))

        return let(F.substring_index(part, '"', 1), lambda inside: F.when(inside.contains("\\"), with_escapes(inside)).otherwise(plain(inside)))

    def rebuilt(starts: Column, ready: Column) -> Column:
        plain = F.replace(F.replace(document, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
        # Any character may come as an escape, and a slash as a backslash.
        forms = F.array_append(F.transform(starts, lambda c: F.translate(c, '"', _QUOTE)), F.lit("\\"))
        forms = F.when(F.array_contains(starts, "/"), F.array_append(forms, F.lit(_BACKSLASH))).otherwise(forms)
        marked = F.aggregate(forms, plain, lambda text, c: F.replace(text, F.concat(F.lit('"'), c), F.concat(F.lit(_MARK), c)))
        parts = F.transform(F.split(marked, _MARK), lambda part, i: F.when(i == 0, part).otherwise(rewritten(part, ready)))
        return F.replace(F.replace(F.array_join(parts, ""), F.lit(_BACKSLASH), F.lit("\\\\")), F.lit(_QUOTE), F.lit('\\"'))

    def chosen(starts: Column) -> Column:
        # An escaped surrogate without its other half is no text for the JSON functions.
        taken = [document.contains(c) for c in (_BACKSLASH, _QUOTE, _MARK, "\\ud", "\\uD")]
        ambiguous = F.arrays_overlap(starts, F.array(*[F.lit(c) for c in _AMBIGUOUS]))
        whole = map_json_strings(document, lambda value: rewrite_cleaned(value, rules))
        return F.when(rules.isNull() | ambiguous | reduce(or_, taken), whole).otherwise(let(ready, lambda r: rebuilt(starts, r)))

    return let(starts, chosen)
