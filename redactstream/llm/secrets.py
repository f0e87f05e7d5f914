"""Secret scanning behind a trigram inverted index.

Each rule is a small pattern tree from which both its regular expression and a Boolean query
over trigrams are derived: a literal needs all its trigrams, a sequence all its parts', a choice
one of its branches'; what matches freely asks for nothing. Documents are indexed block by
block: an inverted list per trigram that some query asks for. Posting lists are intersected and united
as the query says, and only the documents left are verified with the expression. A rule without
a mandatory trigram (a run of hexadecimal digits) scans every document.

The index folds A-Z to a-z, so that a literal in either case is one query; that only adds
candidates. Blocks hold consecutive rows of a partition, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactstream.llm.subwords import text_slices

BLOCK_CHARS = 1_000_000
ALL, NONE = ("all",), ("none",)


# ------------------------------------------------------------------ pattern trees
@dataclass(frozen=True)
class Lit:
    """Exact text; `fold` matches ASCII letters in either case."""

    text: str
    fold: bool = False

    def regex(self) -> str:
        if not self.fold:
            return re.escape(self.text)
        return "".join(
            f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else re.escape(c) for c in self.text
        )


@dataclass(frozen=True)
class Free:
    """Any expression that demands no particular text."""

    pattern: str

    def regex(self) -> str:
        return self.pattern


@dataclass(frozen=True)
class Choice:
    parts: tuple

    def regex(self) -> str:
        return "(?:" + "|".join(p.regex() for p in self.parts) + ")"


@dataclass(frozen=True)
class Seq:
    parts: tuple

    def regex(self) -> str:
        return "".join(p.regex() for p in self.parts)


def literals(node) -> list[str] | None:
    """The texts a node can match, folded, if they are few and fixed; else None."""
    if isinstance(node, Lit):
        return [node.text.lower()]
    if isinstance(node, Choice):
        found = [literals(p) for p in node.parts]
        return None if any(x is None for x in found) else [t for x in found for t in x]
    if isinstance(node, Seq):
        out = [""]
        for p in node.parts:
            found = literals(p)
            if found is None or len(out) * len(found) > 16:
                return None
            out = [a + b for a in out for b in found]
        return out
    return None


def both(queries: list) -> tuple:
    queries = [q for q in queries if q != ALL]
    return queries[0] if len(queries) == 1 else ("and", *queries) if queries else ALL


def trigram_query(node) -> tuple:
    """The Boolean trigram query that every match of the node satisfies."""
    texts = literals(node)
    if texts is not None:
        each = []
        for t in texts:
            raw = t.encode()
            grams = dict.fromkeys(raw[i : i + 3] for i in range(len(raw) - 2))
            each.append(both([("gram", g) for g in grams]))
        return ALL if ALL in each else each[0] if len(each) == 1 else ("or", *each)
    if isinstance(node, Seq):
        # Neighbouring fixed parts make longer literals with more trigrams.
        groups, run = [], []
        for p in node.parts:
            if literals(p) is not None and (not run or literals(Seq((*run, p))) is not None):
                run.append(p)
            else:
                groups += [Seq(tuple(run))] if run else []
                run = []
                groups.append(p)
        groups += [Seq(tuple(run))] if run else []
        return both([trigram_query(g) for g in groups if len(groups) > 1 or g != node])
    if isinstance(node, Choice):
        each = [trigram_query(p) for p in node.parts]
        return ALL if ALL in each else ("or", *each)
    return ALL


def grams_of(query: tuple) -> list[bytes]:
    if query[0] == "gram":
        return [query[1]]
    return [g for part in query[1:] for g in grams_of(part)]


@dataclass(frozen=True)
class Rule:
    """A kind of secret: pattern, the group whose length counts, and its least length."""

    kind: str
    tree: object
    group: int = 0
    least: int = 1


# The keyword of an assignment, in either case.
KEYWORD = Choice(
    (
        Lit("password", True),
        Lit("passwd", True),
        Lit("secret", True),
        Lit("token", True),
        Seq((Lit("api", True), Choice((Lit("_"), Lit(""))), Lit("key", True))),
    )
)
BASE = (
    Rule(
        "assign",
        Seq((KEYWORD, Free(r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"))),
        group=1,
        least=8,
    ),
    Rule("access", Seq((Lit("AKIA"), Free("[A-Z0-9]+"))), least=16),
    # Runs of any length match, those under 32 drop: the same as runs of 32 and more.
    Rule("hex", Free("[0-9a-f]{32,}"), least=32),
)
# What follows the first line of a private key: all up to its last line, or, if that is missing, header lines and
# base64, as lines of any length or as runs of 16 and more; line ends may be written as \n.
KEY_END = r"(?:(?!-----BEGIN )[\s\S])*?-----END (?:[A-Z]+ )*PRIVATE KEY-----"
KEY_GAP = r"(?:[\s\"',>|*#;]|\\[nrt])+"
KEY_BODY = (
    rf"(?:{KEY_GAP}(?:[A-Z][A-Za-z0-9]*-[A-Za-z0-9-]+|Comment): (?:(?!\\n)[^\n])*)*"
    rf"(?:{KEY_GAP}[A-Za-z0-9+/]{{16,}}={{0,2}}"
    rf"|{KEY_GAP}(?:(?<=[\r\n>|*# ])|(?<=\\[nr]))[A-Za-z0-9+/]+={{0,2}}(?=[\x20\t]*(?:[\r\n\"']|\\[nr]|\Z)))*"
)
# Public token shapes beyond the base kinds.
MORE = (
    Rule(
        "private_key",
        Seq((Lit("-----BEGIN "), Free("(?:[A-Z]+ )*"), Lit("PRIVATE KEY-----"), Free(f"(?:{KEY_END}|{KEY_BODY})"))),
    ),
    Rule(
        "repo_token",
        Seq((Lit("gh"), Choice(tuple(Lit(f"{c}_") for c in "pousr")), Free("[A-Za-z0-9]{36,}"))),
    ),
    Rule("chat_token", Seq((Lit("xox"), Choice(tuple(Lit(f"{c}-") for c in "abprs")), Free("[A-Za-z0-9-]{10,}")))),
    Rule("web_token", Seq((Lit("eyJ"), Free(r"[A-Za-z0-9_-]{8,}\."), Lit("eyJ"), Free(r"[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")))),
    Rule("maps_key", Seq((Lit("AIza"), Free("[A-Za-z0-9_-]{35}")))),
)
BASE_KINDS = tuple(r.kind for r in BASE)


class TrigramBlock:
    """The inverted index of one block of texts, for the trigrams that queries ask for."""

    def __init__(self, wanted: dict[bytes, int]):
        self.wanted = wanted
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        self.fold = fold
        self.table = np.zeros(1 << 24, np.uint8 if len(wanted) < 256 else np.uint16)
        for g, i in wanted.items():
            self.table[g[0] << 16 | g[1] << 8 | g[2]] = i + 1

    def index(self, texts: list[str]) -> None:
        raw = [t.encode() for t in texts]
        # Three zero bytes keep trigrams from spanning texts.
        data = self.fold[np.frombuffer(b"\0\0\0".join(raw) + b"\0\0\0", np.uint8)].astype(np.uint32)
        at = np.cumsum([0] + [len(b) + 3 for b in raw])
        codes = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        hit = self.table[codes]
        where = np.flatnonzero(hit)
        docs = np.searchsorted(at, where, side="right") - 1
        pairs = np.unique((hit[where].astype(np.int64) - 1) * len(texts) + docs)
        grams, docs = np.divmod(pairs, max(len(texts), 1))
        bounds = np.searchsorted(grams, np.arange(len(self.wanted) + 1))
        self.n = len(texts)
        self.postings = [docs[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def candidates(self, query: tuple):
        """Documents that satisfy the query, ascending."""
        if query[0] == "all":
            return np.arange(self.n)
        if query[0] == "gram":
            return self.postings[self.wanted[query[1]]]
        lists = sorted((self.candidates(q) for q in query[1:]), key=len)
        out = lists[0]
        for other in lists[1:]:
            if query[0] == "or":
                out = np.union1d(out, other)
            elif len(out):
                out = np.intersect1d(out, other, assume_unique=True)
        return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.tree.regex()), trigram_query(r.tree)) for r in rules]
        grams = dict.fromkeys(g for _, _, q in self.rules for g in grams_of(q))
        self.block = TrigramBlock({g: i for i, g in enumerate(grams)})

    def scan(self, texts: list) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of every text's matches, by start and then rule order."""
        texts = [t or "" for t in texts]
        self.block.index(texts)
        found: list[list] = [[] for _ in texts]
        for order, (rule, pattern, query) in enumerate(self.rules):
            for d in self.block.candidates(query).tolist():
                for m in pattern.finditer(texts[d]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[d].append((m.start(), order, m.end()))
        return [[(a, e, self.rules[o][0].kind) for a, o, e in sorted(x)] for x in found]


SPANS = "array<struct<kind:string,start:int,end:int>>"


def mask(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    """The text with its spans, sorted by start, replaced; overlapping or touching ones become one mark."""
    out, done, open_ = [], 0, False
    for start, end, _ in spans:
        if start > done or not open_:
            out += [text[done:start], mark]
        done, open_ = max(done, end), True
    return "".join(out) + text[done:]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id and `secrets`, the spans of every match in the whole text.

    Positions are code points, ends exclusive; spans go by start, then rule order. A null or
    empty text has none. Each row is scanned on its own: repeated rows give repeated results.
    Matches of one rule never overlap; matches of different rules may.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        scanner = Scanner(rules)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out: list = []
            for a, b in text_slices(texts, BLOCK_CHARS):
                out += scanner.scan(texts[a:b])
            counts = pa.array(np.cumsum([0] + [len(x) for x in out]), pa.int32())
            flat = [s for x in out for s in x]
            spans = pa.StructArray.from_arrays(
                [
                    pa.array([s[2] for s in flat], pa.string()),
                    pa.array([s[0] for s in flat], pa.int32()),
                    pa.array([s[1] for s in flat], pa.int32()),
                ],
                ["kind", "start", "end"],
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(counts, spans)], ["doc_id", "secrets"]
            )

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, f"doc_id long, secrets {SPANS}")


def joined(spans) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secret_digest(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the digest of the base spans, and all spans as text."""
    found = find_secrets(docs)
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(k) for k in BASE_KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def blank_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every match of every rule replaced by a mark; all columns stay.

    Overlapping or touching spans become one mark. `n_chars`, where there is such a column, is
    counted anew for texts that change. Null texts stay null; no row is dropped.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        scanner = Scanner(rules)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out: list = []
            for a, b in text_slices(texts, BLOCK_CHARS):
                for text, spans in zip(texts[a:b], scanner.scan(texts[a:b])):
                    out.append(mask(text, spans, mark) if spans else text)
            changed = pa.array([x is not y for x, y in zip(out, texts)], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.string()), changed], ["rest", "text", "changed"]
            )

    rest = F.struct(*[c for c in docs.columns if c != "text"])
    source = docs.select(rest.alias("rest"), F.col("text").cast("string"))
    kind = source.schema["rest"].dataType.simpleString()
    out = source.mapInArrow(run, f"rest {kind}, text string, changed boolean")

    def column(name: str):
        old = F.col("rest")[name]
        if name == "text":
            return F.col("text")
        if name == "n_chars":
            count = F.length("text").cast(docs.schema[name].dataType)
            return F.when(F.col("changed"), count).otherwise(old).alias(name)
        return old.alias(name)

    return out.select(*map(column, docs.columns))
