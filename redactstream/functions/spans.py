"""Regex hits with offsets, and the algebra over finding arrays.

Everything here maps Columns to Columns and stays inside one row, so the same
expressions run in batch and on a stream without a shuffle. Offsets are half-open
and count code points, as Spark's own string functions do.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import is_remote

from redactstream.schema import FINDING, FINDINGS, HIT, MERGED

# Python's notion of space, digit and word character, spelled out because Java's
# shorthand classes differ from it at the edges.
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
DIGIT = r"\p{Nd}"
WORD = r"\p{L}\p{N}_"
WORD_START = rf"(?<![{WORD}])(?=[{WORD}])"
WORD_END = rf"(?<=[{WORD}])(?![{WORD}])"


TREES = 256


class built_once:
    """Keep the expressions that a function makes of column names and other plain values.

    A detection tree has thousands of parts, each a call into the JVM, so building one can take
    longer than planning the job. A tree names its columns and belongs to no table or session:
    one serves every job of the process. Functions among the arguments are told apart by identity;
    with arguments that cannot be hashed the tree is built anew. Results must not be changed.
    Each function keeps its last TREES trees; they do not travel to workers.
    """

    def __init__(self, build: Callable) -> None:
        self.build = build
        self.kept: dict[tuple, Column | dict[str, Column]] = {}
        functools.update_wrapper(self, build)

    def __reduce__(self):
        return built_once, (self.build,)

    def __call__(self, *args):
        key = (is_remote(), *args)
        try:
            tree = self.kept.get(key)
        except TypeError:
            return self.build(*args)
        if tree is None:
            tree = self.build(*args)
            if len(self.kept) >= TREES:
                self.kept.pop(next(iter(self.kept)), None)
            self.kept[key] = tree
        return tree


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expression so that `body` can use it many times at one evaluation."""
    return F.transform(F.array(value), body)[0]


def once(value: Column) -> Column:
    """Evaluate an expensive column once, however often and wherever it is used later.

    Catalyst moves filters below projections and merges projections by repeating their
    expressions; a chain of detection steps would run many times over. It leaves a column
    that is not deterministic in its place. The condition always holds.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def stage(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns that are all evaluated once, together.

    One packed column also keeps the optimizer's reasoning about equal columns small,
    which otherwise grows with every pair of columns along a chain of projections.
    """
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    out = df.withColumn("_stage", once(packed))
    return out.select(*kept, *[F.col("_stage")[n].alias(n) for n in columns])


def empty(kind: str) -> Column:
    return F.array().cast(kind)


# Long arrays are scanned in blocks, so a text with many thousand hits stays practical.
BLOCK = 64


def _prefix(values: Column, total: Callable[[Column], Column], plus) -> Column:
    """Exclusive running totals of an array: totals of whole blocks, then inside a block."""

    def scan(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.ceil(F.size(v) / BLOCK).cast("int") - 1)
        sums = F.transform(blocks, lambda b: total(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))

        def spread(t: Column) -> Column:
            before = F.transform(t, lambda _, b: total(F.slice(t, F.lit(1), b)))

            def each(p: Column) -> Column:
                return F.transform(
                    v,
                    lambda _, i: plus(
                        F.get(p, F.floor(i / BLOCK).cast("int")),
                        total(F.slice(v, i - i % BLOCK + 1, i % BLOCK)),
                    ),
                )

            return let(before, each)

        return let(sums, spread)

    return let(values, scan)


def running_sum(values: Column) -> Column:
    def total(v: Column) -> Column:
        return F.aggregate(v, F.lit(0), lambda acc, x: acc + x)

    return _prefix(values, total, lambda a, b: a + b)


def running_max(values: Column) -> Column:
    """Of non-negative integers; -1 before the first."""

    def total(v: Column) -> Column:
        return F.coalesce(F.array_max(v), F.lit(-1))

    return _prefix(values, total, F.greatest)


def segments(rows: Column, opens: Callable[[Column, Column], Column]) -> Column:
    """Cut a sorted, non-empty array of spans (fields s, e) into consecutive groups.

    `opens(row, reach)` says whether a row starts a new group, given the furthest end
    among all rows before it.
    """

    def cut(r: Column) -> Column:
        def heads(reach: Column) -> Column:
            at = F.sequence(F.lit(0), F.size(r) - 1)
            return F.filter(at, lambda i: (i == 0) | opens(F.get(r, i), F.get(reach, i)))

        def groups(h: Column) -> Column:
            return F.transform(
                h,
                lambda at, j: F.slice(r, at + 1, F.coalesce(F.get(h, j + 1), F.size(r)) - at),
            )

        return let(let(running_max(F.transform(r, lambda x: x["e"])), heads), groups)

    return let(rows, cut)


def find_spans(text: Column, pattern: str) -> Column:
    """All non-overlapping matches as array<struct<s,e,m>>.

    Spark has no function that returns match offsets. The pieces between matches
    (`split`) and the matches (`regexp_extract_all`) interleave to the whole text,
    so running sums of their lengths give them. The second pass over the text only
    happens for rows that have a match. It compiles its pattern for every value, so a lone
    match that is the whole text, or that occurs in it only once, is placed without it.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def hit(s: Column, m: Column) -> Column:
        return F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m"))

    def single(found: Column, gaps: Column) -> Column:
        return F.transform(found, lambda m: hit(F.get(gaps, F.lit(0)), m))

    def many(found: Column, gaps: Column) -> Column:
        steps = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.length(m) + g)
        return let(
            running_sum(steps),
            lambda at: F.transform(found, lambda m, i: hit(F.get(at, i) + F.get(gaps, i), m)),
        )

    def cut(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        return let(
            gaps,
            lambda g: F.when(F.size(found) == 1, single(found, g)).otherwise(many(found, g)),
        )

    def place(found: Column) -> Column:
        m, alone = F.get(found, F.lit(0)), F.size(found) == 1
        at = F.instr(text, m)
        # Text that is not valid UTF-8 is matched in another form than it is searched in.
        sole = (at > 0) & (F.position(m, text, at + 1) == 0)
        some = (
            F.when(alone & (m == text), F.array(hit(F.lit(0), m)))
            .when(alone & sole, F.array(hit(at - 1, m)))
            .otherwise(cut(found))
        )
        return F.when(F.size(found) > 0, some).otherwise(empty(f"array<{HIT}>"))

    return let(hits, place)


def finding(entity: Column, field: Column, s: Column, e: Column, tier: int, conf: Column) -> Column:
    return F.struct(
        entity.alias("entity_type"),
        field.alias("field"),
        s.cast("int").alias("span_start"),
        e.cast("int").alias("span_end"),
        F.lit(tier).alias("tier"),
        conf.cast("double").alias("confidence"),
    )


def joined(*parts: Column) -> Column:
    """The arrays one after the other; inside a lambda `concat` builds a lazy list per value."""
    return F.flatten(F.array(*parts))


def dedupe_longest(found: Column) -> Column:
    """Overlapping rule hits: the longest claims the text, earlier detectors win ties.

    `found` lists hits detector by detector, so its index is the tie order. The contest
    is inside groups that overlap; a text with many hits compares no hit with all others.
    """

    def contest(group: Column) -> Column:
        ranked = F.array_sort(
            F.transform(
                group,
                lambda x: F.struct(
                    (x["s"] - x["e"]).alias("neg_len"), x["i"].alias("i"), x["h"].alias("h")
                ),
            )
        )

        def claim(acc: Column, r: Column) -> Column:
            taken = F.exists(
                acc,
                lambda a: (r["h"]["span_start"] < a["span_end"])
                & (a["span_start"] < r["h"]["span_end"]),
            )
            return F.when(taken, acc).otherwise(F.concat(acc, F.array(r["h"])))

        return by_position(F.aggregate(ranked, empty(FINDINGS), claim), with_end=False)

    def settle(group: Column) -> Column:
        alone = F.transform(group, lambda x: x["h"])
        return F.when(F.size(group) > 1, contest(group)).otherwise(alone)

    def resolve(hits: Column) -> Column:
        ordered = F.array_sort(
            F.transform(
                hits,
                lambda h, i: F.struct(
                    h["span_start"].alias("s"), i.alias("i"), h["span_end"].alias("e"), h.alias("h")
                ),
            )
        )
        groups = segments(ordered, lambda x, reach: x["s"] >= reach)
        return F.flatten(F.transform(groups, settle))

    return let(found, lambda h: F.when(F.size(h) > 1, resolve(h)).otherwise(h))


def by_position(found: Column, with_end: bool = True) -> Column:
    """Findings sorted by (start, end), or by start only; equal keys keep their order."""

    def keyed(h: Column, i: Column) -> Column:
        end = h["span_end"] if with_end else F.lit(0)
        return F.struct(h["span_start"].alias("s"), end.alias("e"), i.alias("i"), h.alias("h"))

    return F.transform(F.array_sort(F.transform(found, keyed)), lambda x: x["h"])


def combine(rules: Column, model: Column) -> Column:
    """Rule findings, plus model findings that no single rule span fully contains.

    A model span lies inside some rule span exactly when the furthest end among the rule spans
    that start no later reaches its own end: one running maximum over both in order of start.
    """

    def event(f: Column, is_model: int, i: Column) -> Column:
        return F.struct(
            f["span_start"].alias("s"), F.lit(is_model).alias("model"), i.alias("i"), f["span_end"].alias("e")
        )

    def reaches(events: Column) -> Column:
        ends = F.transform(events, lambda x: F.when(x["model"] == 0, x["e"]).otherwise(-1))

        def per_model(reach: Column) -> Column:
            own = F.transform(
                events, lambda x, k: F.when(x["model"] == 1, F.struct(x["i"].alias("i"), F.get(reach, k).alias("reach")))
            )
            return F.array_sort(F.filter(own, lambda x: x.isNotNull()))

        return let(running_max(ends), per_model)

    def outside() -> Column:
        first = F.transform(rules, lambda f: event(f, 0, F.lit(0)))
        events = F.array_sort(F.concat(first, F.transform(model, lambda f, i: event(f, 1, i))))
        reach = let(events, reaches)
        return let(reach, lambda r: F.filter(model, lambda f, i: F.get(r, i)["reach"] < f["span_end"]))

    both = (F.size(rules) > 0) & (F.size(model) > 0)
    return F.concat(rules, F.when(both, outside()).otherwise(model))


def merge_spans(found: Column) -> Column:
    """Union strictly overlapping findings: array<struct<s,e,label>>, ascending.

    Touching spans stay apart. A merged label lists its distinct types joined by '+'.
    """

    def triple(f: Column, label: str) -> Column:
        return F.struct(
            f["span_start"].alias("s"), f["span_end"].alias("e"), f["entity_type"].alias(label)
        )

    def union(group: Column) -> Column:
        kinds = F.array_sort(F.array_distinct(F.transform(group, lambda x: x["t"])))
        return F.struct(
            F.get(group, F.lit(0))["s"].alias("s"),
            F.array_max(F.transform(group, lambda x: x["e"])).alias("e"),
            F.array_join(kinds, "+").alias("label"),
        )

    ordered = F.array_sort(F.transform(found, lambda f: triple(f, "t")))
    groups = segments(ordered, lambda x, reach: x["s"] >= reach)
    # Most values hold one finding or none.
    return (
        F.when(F.size(found) == 1, F.transform(found, lambda f: triple(f, "label")))
        .when(F.size(found) > 1, F.transform(groups, union))
        .otherwise(empty(f"array<{MERGED}>"))
    )


def _rewrite(text: Column, merged: Column, fill: Callable[[Column], Column]) -> Column:
    """The text with each merged span replaced, put together block by block of spans."""

    def stitched(m: Column) -> Column:
        def block(first: Column) -> Column:
            group = F.slice(m, first + 1, F.lit(BLOCK))
            begin = F.when(first > 0, F.get(m, first)["s"]).otherwise(F.lit(0))
            end = F.coalesce(F.get(m, first + BLOCK)["s"], F.length(text))
            parts = F.struct(
                group.alias("spans"),
                begin.alias("begin"),
                F.substring(text, begin + 1, end - begin).alias("text"),
            )
            return let(parts, paste)

        def paste(p: Column) -> Column:
            def piece(x: Column, i: Column) -> Column:
                prev = F.when(i > 0, F.get(p["spans"], i - 1)["e"]).otherwise(p["begin"])
                kept = F.substring(p["text"], prev - p["begin"] + 1, x["s"] - prev)
                return F.concat(kept, fill(x))

            last = F.element_at(p["spans"], -1)["e"] - p["begin"]
            tail = F.substring(p["text"], last + 1, F.length(p["text"]))
            return F.concat(F.array_join(F.transform(p["spans"], piece), ""), tail)

        firsts = F.sequence(F.lit(0), F.size(m) - 1, F.lit(BLOCK))
        return F.array_join(F.transform(firsts, block), "")

    return let(merged, lambda m: F.when(F.size(m) > 0, stitched(m)).otherwise(text))


def _label(x: Column) -> Column:
    return F.concat(F.lit("["), x["label"], F.lit("]"))


def redact_merged(text: Column, merged: Column) -> Column:
    return _rewrite(text, merged, _label)


def _rewrite_found(text: Column, found: Column, fill: Callable[[Column], Column]) -> Column:
    """`_rewrite` over merged findings; a lone finding needs neither merging nor blocks."""

    def one(f: Column) -> Column:
        x = F.struct(f["span_start"].alias("s"), f["span_end"].alias("e"), f["entity_type"].alias("label"))
        before = F.substring(text, F.lit(1), f["span_start"])
        after = F.substring(text, f["span_end"] + 1, F.length(text))
        return F.array_join(F.array(before, fill(x), after), "")

    return (
        F.when(F.size(found) == 0, text)
        .when(F.size(found) == 1, one(F.get(found, F.lit(0))))
        .otherwise(_rewrite(text, merge_spans(found), fill))
    )


def redact(text: Column, found: Column) -> Column:
    """Replace every merged span by its bracketed label."""
    return _rewrite_found(text, found, _label)


@built_once
def redacted_column(text: str, found: str) -> Column:
    """`redact` over the named columns, built once."""
    return redact(F.col(text), F.col(found))


def shield(text: Column, found: Column) -> Column:
    """Blank what rules already claimed, keeping the length, so offsets stay valid."""
    return _rewrite_found(text, found, lambda x: F.repeat(F.lit(" "), x["e"] - x["s"]))


def bridge_spans(spans: Column, max_gap: int = 32) -> Column:
    """Join array<struct<s,e,score>> members whose gap is at most `max_gap`."""

    def pack(s: Column, e: Column, score: Column) -> Column:
        return F.struct(
            s.cast("int").alias("s"), e.cast("int").alias("e"), score.cast("double").alias("score")
        )

    def join(group: Column) -> Column:
        return pack(
            F.get(group, F.lit(0))["s"],
            F.array_max(F.transform(group, lambda x: x["e"])),
            F.array_max(F.transform(group, lambda x: x["score"])),
        )

    ordered = F.array_sort(F.transform(spans, lambda x: pack(x["s"], x["e"], x["score"])))
    groups = segments(ordered, lambda x, reach: x["s"] - reach > max_gap)
    return F.when(F.size(spans) > 0, F.transform(groups, join)).otherwise(
        empty("array<struct<s:int,e:int,score:double>>")
    )


def keep_types(found: Column, types: Sequence[str] | None) -> Column:
    if types is None:
        return found
    wanted = list(types)
    return F.filter(found, lambda f: f["entity_type"].isin(wanted))


def identifying_chars(text: Column) -> Column:
    """Letters and numbers only: spaces and punctuation carry no identity."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def masked_chars(text: Column, merged: Column) -> Column:
    """Identifying characters inside merged spans."""
    parts = F.transform(merged, lambda x: F.substring(text, x["s"] + 1, x["e"] - x["s"]))
    return F.when(F.size(merged) > 0, identifying_chars(F.array_join(parts, ""))).otherwise(
        F.lit(0)
    )


def span_length(merged: Column) -> Column:
    return F.aggregate(merged, F.lit(0), lambda acc, x: acc + x["e"] - x["s"])


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def clip(text: Column, max_chars: int) -> Column:
    return F.left(text, F.lit(max_chars))
