"""Personal data in DataFrame operations: base patterns, and boosted trees over wider candidates.

The base spans follow fixed patterns and checks.  High-recall generators propose further,
overlapping candidates; boosted trees over their format and context, with a threshold
calibrated on all candidates of the corpus, select those to redact as well.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees, calibrated_threshold
from .common import bounded_sample, materialize, row_key, text_of

KINDS = ["email", "ip", "card", "phone"]
# The patterns of the base spans.  Possessive quantifiers and the guards at a
# run's start change no match: inside a run that failed from its start no later start succeeds.
_BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be worth a pass.
_HINT = {"email": "contains(text, '@')", "ip": r"text rlike '[0-9]\\.[0-9]'",
         "card": r"text rlike '[0-9](?:[ -]?[0-9]){11}'", "phone": r"text rlike '\\+[0-9]'"}
#: The generators: recall first, so they overlap each other and the base spans.
_WIDE = {
    "email": r"(?i)[A-Z0-9._%+-]++ ?(?:@|\(at\)|\[at\]|\{at\}) ?[A-Z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Z0-9-]++)*+",
    "ip": r"(?<![0-9A-Za-z.:])(?:[0-9]{1,3}(?:[.,][0-9]{1,3}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7})(?![0-9A-Za-z])",
    "card": r"(?<![0-9])[0-9](?:[ .-]?[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00)?\(?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}(?![0-9])",
}
_WIDE_HINT = {"email": r"text rlike '(?i)@|[\\(\\[{]at[\\)\\]}]'", "ip": "text rlike '[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]'",
              "card": "text rlike '[0-9](?:[ .-]?[0-9]){11}'", "phone": r"text rlike '[0-9](?:[ ()./-]{0,2}[0-9]){6}'"}
_CUE = (r"(?i)(?:tel|phone|call|mobile|fax|mail|contact|card|visa|account|iban|ip|host|server|address|reach|"
        r"téléphone|telefon|tarjeta|karte|carte|correo|courriel)\W{0,4}$")
FEATURES = ["kind", "digits", "length", "digit_share", "separators", "groups", "first_group", "last_group", "plus",
            "dots", "parens", "at", "leading", "word_before", "word_after", "mark_before", "mark_after", "cue"]
_STEPS = 1000
_CONTEXT = 24


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``name`` bound to ``value``, which is evaluated once: an expression
    that stands in a lambda would be evaluated for each element."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _walk(items: str, state: dict[str, tuple[str, str, str]], row: str, row_type: str, keep: str = "true") -> str:
    """SQL array of the rows made in one walk over ``items`` (``x``) with a state (``a``; for each
    name its type, start and next value).  Where ``keep`` fails neither a row nor a new state is made.

    An accumulator is copied at every step, so one that holds all rows would make the work
    quadratic.  A first pass takes only the state from block to block of 64 items; the rows are made
    inside each block.
    """
    after = ", ".join(f"{v[2]} as {n}" for n, v in state.items())
    begin = f"struct({', '.join(f'{v[1]} as {n}' for n, v in state.items())})"
    kind = f"struct<{','.join(f'{n}:{v[0]}' for n, v in state.items())}>"
    blocks = _let("z", items, "transform(sequence(0, (size(z) - 1) div 64), j -> slice(z, 64 * j + 1, 64))")
    begins = (f"aggregate(u, struct({begin} as st, cast(array() as array<{kind}>) as out), (o, y) -> struct("
              f"aggregate(y, o.st, (a, x) -> if({keep}, struct({after}), a)) as st, concat(o.out, array(o.st)) as out), o -> o.out)")
    rows = (f"aggregate(y, struct({', '.join(f'st.{n} as {n}' for n in state)}, cast(array() as array<{row_type}>) as cur), "
            f"(a, x) -> if({keep}, struct({after}, concat(a.cur, array({row})) as cur), a), a -> a.cur)")
    return _let("u", blocks, f"flatten(zip_with(u, {begins}, (y, st) -> {rows}))")


def _matches(pattern: str, hint: str, context: bool = False) -> str:
    """SQL array of (s, e, m): places of all matches in code points; with ``context`` also before
    and after, the 24 characters before a match and the two after it.

    The pieces between the matches and the matches themselves, in turn, make up the text; the
    running sum of their lengths gives the places, and the context is taken from the pieces
    beside a match.  Texts without the hint skip both passes.
    """
    p = _sql_text(pattern)
    kind, row = "struct<s:int,e:int,m:string>", "a.at + x.g as s, a.at + x.g + length(x.m) as e, x.m as m"
    pairs = f"zip_with(slice(v.g, 1, size(v.m)), v.m, (g, m) -> struct(length(g) as g, m as m))"
    state = {"at": ("int", "0", "a.at + x.g + length(x.m)")}
    if context:
        kind, row = "struct<s:int,e:int,m:string,before:string,after:string>", f"{row}, right(concat(a.tail, x.b), {_CONTEXT}) as before, x.z as after"
        pairs = (f"zip_with(zip_with(slice(v.g, 1, size(v.m)), v.m, (g, m) -> struct(length(g) as g, right(g, {_CONTEXT}) as b, m as m)), "
                 "zip_with(slice(v.g, 2, size(v.m)), slice(v.m, 2, size(v.m)), (g, m) -> left(concat(left(g, 2), coalesce(left(m, 2), '')), 2)), "
                 "(x, z) -> struct(x.g as g, x.b as b, x.m as m, z as z))")
        state["tail"] = ("string", "''", f"right(concat(a.tail, x.b, right(x.m, {_CONTEXT})), {_CONTEXT})")
    walked = _let("v", f"struct(split(text, {p}, -1) as g, regexp_extract_all(text, {p}, 0) as m)", _walk(pairs, state, f"struct({row})", kind))
    return f"if({hint}, {walked}, cast(array() as array<{kind}>))"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """Is the check digit right?  Every second digit from the right counts doubled."""
    d = f"cast(substring({digits}, length({digits}) - i, 1) as int)"
    return (f"aggregate(transform(sequence(0, length({digits}) - 1), "
            f"i -> if(i % 2 = 0, {d}, if({d} > 4, 2 * {d} - 9, 2 * {d}))), 0, (a, v) -> a + v) % 10 = 0")


#: The checks that a base match must pass.
_CHECK = {
    "email": "true",
    "ip": "forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', right(ltrim('0', p), 3)) as int) <= 255)",
    "card": f"length({_digits('x.m')}) between 12 and 19 and {_luhn(_digits('x.m'))}",
    "phone": f"length({_digits('x.m')}) between 9 and 15",
}


def base_spans() -> Column:
    """Array of (s, k, e): the base spans of ``text`` by start, then kind as listed."""
    each = [f"transform(filter({_matches(_BASE[k], _HINT[k])}, x -> {_CHECK[k]}), x -> struct(x.s as s, {i} as k, x.e as e))"
            for i, k in enumerate(KINDS)]
    return F.expr(f"array_sort(concat({', '.join(each)}))")


def candidates() -> Column:
    """Array of (s, k, e, f): the generators' spans of ``text`` with their features."""
    out = []
    for i, k in enumerate(KINDS):
        before, after = "x.before", "x.after"
        n = f"length({_digits('x.m')})"
        groups = "filter(split(x.m, '[^0-9A-Za-z]+'), g -> g <> '')"
        made = {
            "kind": str(i), "digits": n, "length": "length(x.m)", "digit_share": f"{n} / length(x.m)",
            "separators": "length(regexp_replace(x.m, '[0-9A-Za-z]', ''))", "groups": f"size({groups})",
            "first_group": f"coalesce(length(get({groups}, 0)), 0)",
            "last_group": f"coalesce(length(get({groups}, size({groups}) - 1)), 0)",
            "plus": "if(x.m like '+%', 1, 0)", "dots": "length(x.m) - length(replace(x.m, '.', ''))",
            "parens": "if(x.m like '%(%', 1, 0)", "at": "if(x.m like '%@%', 1, 0)",
            "leading": f"coalesce(try_cast(left({_digits('x.m')}, 1) as int), -1)",
            "word_before": f"if({before} rlike '[A-Za-z0-9]$', 1, 0)", "word_after": f"if({after} rlike '^[A-Za-z0-9]', 1, 0)",
            "mark_before": f"if({before} rlike '[^A-Za-z0-9 ]$', 1, 0)", "mark_after": f"if({after} rlike '^[^A-Za-z0-9 ]', 1, 0)",
            "cue": f"if({before} rlike {_sql_text(_CUE)}, 1, 0)",
        }
        row = ", ".join(f"cast({made[f]} as double)" for f in FEATURES)
        out.append(f"transform({_matches(_WIDE[k], _WIDE_HINT[k], context=True)}, x -> struct(x.s as s, {i} as k, x.e as e, array({row}) as f))")
    return F.expr(f"concat({', '.join(out)})")


def _bounded_blocks(spans: str) -> str:
    """SQL of the sorted ``spans`` in blocks of 64, and these in blocks of 64, each with the least
    start and the greatest end inside, so that a look-up passes over what cannot overlap."""
    block = lambda d, inside: f"struct(get({d}, 0).s as s, array_max(transform({d}, y -> y.e)) as e, {inside} as i)"
    small = f"transform(sequence(0, (size(c) - 1) div 64), j -> {_let('d', 'slice(c, 64 * j + 1, 64)', block('d', 'd'))})"
    large = f"transform(sequence(0, (size({spans}) - 1) div 4096), i -> {_let('c', f'slice({spans}, 4096 * i + 1, 4096)', block('c', small))})"
    return f"filter({large}, p -> p.s is not null)"


def _overlaps(blocks: str, also: str) -> str:
    """SQL: does ``x`` overlap a span ``b`` of the blocks for which ``also`` holds?"""
    near = lambda v: f"{v}.s < x.e and x.s < {v}.e"
    return f"exists({blocks}, p -> {near('p')} and exists(p.i, q -> {near('q')} and exists(q.i, b -> {near('b')} and {also})))"


def _spans_text(spans: str) -> Column:
    kind = "element_at(array({}), x.k + 1)".format(", ".join(f"'{k}'" for k in KINDS))
    return F.expr(f"array_join(transform(array_sort({spans}), x -> concat({kind}, ':', x.s, ':', x.e)), ',')")


def find_personal_data(docs: DataFrame, fit_rows: int = 8000, precision: float = 0.98, trees: int = 30) -> DataFrame:
    """doc_id, doc_key, base and extra (arrays of (s, k, e): start, number of the kind in
    ``KINDS``, end; code points, end exclusive) and spans (text) of every row of ``docs``.

    A candidate that covers a base span of its kind, or lies in one, is an example of personal
    data, any other of none: the trees learn what base spans look like by format and context
    (not by the checks), and then propose look-alikes that fail a check or are written
    otherwise.  They are fitted on at most ``fit_rows`` candidates (the first in a hash order);
    the threshold is the lowest at which ``precision`` of all candidates at or above it are
    examples.  Candidates from there on that overlap no base span are extra spans; overlapping
    extra spans go to the one that starts first, the longer one on a tie.

    Null and empty texts have no spans; a null doc_id stays null; repeated rows each get a row;
    an empty table gives no rows; further columns are ignored.  The only shuffles carry
    candidates for the sample and counts.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("doc_key"), text_of().alias("text"))
    covers = "b.k = x.k and (b.s <= x.s and x.e <= b.e or x.s <= b.s and b.e <= x.e)"
    marked = f"transform(cands, x -> struct(x.s as s, x.k as k, x.e as e, x.f as f, {_overlaps('blocks', covers)} as label, {_overlaps('blocks', 'true')} as meets))"
    found = texts.select("doc_id", "doc_key", base_spans().alias("base"), candidates().alias("cands"))
    found = found.select("doc_id", "doc_key", "base", F.expr(_let("blocks", _bounded_blocks("base"), marked)).alias("cands"))
    found = materialize(found, "spans")
    each = found.where("size(cands) > 0").select("doc_key", F.explode("cands").alias("x")).select("doc_key", "x.*")
    sample = bounded_sample(each, fit_rows, "doc_key", "s", "k", "e")
    labels = np.array([r["label"] for r in sample], float)
    extra = F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")
    if 0 < labels.sum() < len(labels):
        model = BoostedTrees(np.array([r["f"] for r in sample]), labels, trees)
        score = model.sql([f"x.f[{i}]" for i in range(len(FEATURES))])
        step = F.expr(f"cast(floor({score.replace('x.f', 'f')} * {_STEPS}) as int)")
        tally = each.groupBy(step.alias("step"), F.col("label").cast("int").alias("label")).count().collect()
        cut = calibrated_threshold([(r["step"], r["label"], r["count"]) for r in tally], _STEPS, precision)
        chosen = f"filter(cands, x -> not x.meets and cast(floor({score} * {_STEPS}) as int) >= {cut})"
        # by start, the longer first; one that overlaps the last one kept goes
        ordered = f"array_sort({chosen}, (l, r) -> if(l.s <> r.s, l.s - r.s, if(l.e <> r.e, r.e - l.e, l.k - r.k)))"
        extra = F.expr(_walk(ordered, {"at": ("int", "0", "x.e")}, "struct(x.s as s, x.k as k, x.e as e)", "struct<s:int,k:int,e:int>", "x.s >= a.at"))
    out = found.withColumn("extra", extra)
    return out.select("doc_id", "doc_key", "base", "extra", _spans_text("concat(base, extra)").alias("spans"))


def base_digest() -> Column:
    """The base spans as one text: kind:start:end, comma-joined."""
    return _spans_text("base")


def count_of(kind: str) -> Column:
    return F.expr(f"cast(size(filter(base, x -> x.k = {KINDS.index(kind)})) as bigint)")


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; all columns stay."""
    spans = (find_personal_data(docs, **options).dropDuplicates(["doc_key"])
             .select(F.col("doc_key").alias("_spans_of"), F.array_sort(F.concat("base", "extra")).alias("_spans")))
    kind = "element_at(array({}), x.k + 1)".format(", ".join(f"'[{k}]'" for k in KINDS))
    keyed = docs.withColumn("_key", row_key()).join(spans, F.col("_key") == F.col("_spans_of"), "left")
    # p, the end of the span before; large blocks of the text first, then small ones, then the spans
    kept = _walk("_spans", {"at": ("int", "0", "x.e")}, "struct(a.at as p, x.s as s, x.k as k, x.e as e)", "struct<p:int,s:int,k:int,e:int>", "x.s >= a.at")
    cut = lambda text, at, x: f"substring({text}, get({x}, 0).p - {at} + 1, get({x}, size({x}) - 1).e - get({x}, 0).p)"
    spans = f"array_join(transform(w.c, x -> concat(substring(w.t, x.p - get(w.c, 0).p + 1, x.s - x.p), {kind})), '')"
    small = _let("w", f"struct(slice(v.c, 64 * j + 1, 64) as c, {cut('v.t', 'get(v.c, 0).p', 'slice(v.c, 64 * j + 1, 64)')} as t)", spans)
    small = f"array_join(transform(sequence(0, (size(v.c) - 1) div 64), j -> {small}), '')"
    large = _let("v", f"struct(slice(r, 4096 * i + 1, 4096) as c, {cut('text', '0', 'slice(r, 4096 * i + 1, 4096)')} as t)", small)
    large = f"array_join(transform(sequence(0, (size(r) - 1) div 4096), i -> {large}), '')"
    text = F.expr(_let("r", kept, f"concat({large}, substring(text, get(r, size(r) - 1).e + 1))"))
    return (keyed.withColumn("text", F.when(F.col("text").isNull() | (F.size("_spans") == 0), F.col("text")).otherwise(text))
            .drop("_key", "_spans_of", "_spans"))
