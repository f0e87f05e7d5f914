"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and every run of characters other than letters and digits becomes one
blank. Every test item is looked for whole, and a longer one in overlapping windows besides, so that
a part of an item is found too: PASSAGE characters of an item, copied as they are, hold a whole short
window wherever they begin. Wide windows find longer parts with more edits. A pattern (item or window) that may hold k edits is split into k+1
pieces: within k edits at least one piece stays untouched. One automaton finds all pieces of all
patterns in one pass over the whole text; around the hits, Myers' bit-parallel distance says whether
the pattern occurs within its budget. Every item has the same budget, edits per character; one too short
for an edit is searched as it is, as whole words.

Documents are only mapped over. Test items go to every task in blocks of bounded size, one
pass per block; a benchmark of any size is searched in full.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 0.06
WINDOW, STRIDE = 128, 64
#: The shortest part of an item that is found wherever it begins, and the stride of windows for it.
PASSAGE, PASSAGE_STRIDE = 96, 33
BLOCK_CHARS = 2_000_000
WORD = re.compile(r"[^\W_]+")
#: Thai to Tibetan, Burmese, Khmer, kana and Han: written without blanks, so a word may end anywhere.
UNSPACED = re.compile(
    "[\u0e00-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff"
    "\uf900-\ufaff\uff66-\uff9f\U00016fe0-\U00018cff\U0001aff0-\U0001b16f\U00020000-\U0003ffff]"
)
LEAKS = "doc_id long, item_id long, edits int, start int, end int"


def normalised(text: str | None) -> str:
    return " ".join(WORD.findall(text.lower())) if text else ""


def windows(text: str, window: int = WINDOW, stride: int = STRIDE) -> list[str]:
    """Windows that cover the text, wide ones and short ones; none where the whole text does as well."""
    short = PASSAGE - PASSAGE_STRIDE + 1
    out = covering(text, window, stride) if len(text) > window * 3 // 2 else []
    return out + (covering(text, short, PASSAGE_STRIDE) if len(text) > PASSAGE else [])


def covering(text: str, window: int, stride: int) -> list[str]:
    starts = [*range(0, len(text) - window, stride), len(text) - window]
    return [text[s : s + window] for s in starts]


def pieces(text: str, k: int) -> list[tuple[int, str]]:
    """k+1 pieces of nearly equal length, with their places."""
    cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]


def words_at(text: str, start: int, end: int) -> bool:
    """Whether a normalised text has a border of words at both places."""
    return all(
        at in (0, len(text)) or " " in text[at - 1 : at + 1] or UNSPACED.search(text, at - 1, at + 1) is not None
        for at in (start, end)
    )


class Pattern:
    """Myers' bit vectors of one item or window."""

    def __init__(self, text: str, budget: int):
        self.text = text
        self.n, self.budget = len(text), budget
        self.top = 1 << (self.n - 1)
        self.full = (1 << self.n) - 1
        self.at: dict[str, int] = {}
        for i, c in enumerate(text):
            self.at[c] = self.at.get(c, 0) | 1 << i

    def best(self, text: str, anchored: bool = False) -> tuple[int, int] | None:
        """Least edits with which the pattern occurs in the text, and where that ends; None beyond the budget.

        An anchored occurrence begins where the text does.
        """
        vp, vn, score, best = self.full, 0, self.n, None
        get, top, full, first = self.at.get, self.top, self.full, int(anchored)
        for j, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | vn
            xh = (((eq & vp) + vp) ^ vp) | eq
            hp = vn | ~(xh | vp) & full
            hn = vp & xh
            if hp & top:
                score += 1
            elif hn & top:
                score -= 1
            hp = (hp << 1 | first) & full
            vp = (hn << 1 & full) | ~(xv | hp) & full
            vn = hp & xv
            if score <= self.budget and (best is None or score < best[0]):
                best = (score, j + 1)
        return best

    def begin(self, text: str, end: int) -> int:
        """Where the shortest of the occurrences that end there with the least edits begins."""
        found = Pattern(self.text[::-1], self.budget).best(text[max(0, end - self.n - self.budget) : end][::-1], True)
        return end - found[1]


class Matcher:
    """All items of a block and their windows, behind one automaton over their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.rate = rate
        self.texts: list[tuple[int, bool, str]] = []
        self.patterns: dict[int, Pattern] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            for whole, w in [(True, text), *((False, w) for w in windows(text))]:
                for at, piece in pieces(w, int(len(w) * rate)):
                    places.setdefault(piece, []).append((len(self.texts), at))
                self.texts.append((item_id, whole, w))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def pattern(self, number: int) -> Pattern:
        """Bit vectors are made when a piece is first met."""
        if number not in self.patterns:
            text = self.texts[number][2]
            self.patterns[number] = Pattern(text, int(len(text) * self.rate))
        return self.patterns[number]

    def leaks(self, text: str) -> dict[int, tuple[int, int, int]]:
        """Per item found: least edits, and start and end of that place in the normalised text.

        The place is that of the whole item if it is there within its budget, else that of a window.
        """
        if not self.texts:
            return {}
        starts: dict[int, set[int]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for number, at in where:
                # Hits on one diagonal say the same.
                starts.setdefault(number, set()).add(last + 1 - size - at)
        found: dict[bool, dict[int, tuple[int, int, int]]] = {True: {}, False: {}}
        for number in sorted(starts, key=lambda n: not self.texts[n][1]):
            item_id, whole, w = self.texts[number]
            if whole and int(len(w) * self.rate) == 0:
                exact = [(0, a, a + len(w)) for a in starts[number] if words_at(text, a, a + len(w))]
                if exact:
                    found[True][item_id] = min(found[True].get(item_id, exact[0]), *exact)
                continue
            if len(text) < len(w) - int(len(w) * self.rate) or not whole and item_id in found[True]:
                continue
            pattern, places = self.pattern(number), found[whole]
            for low, high in spans(starts[number], pattern.n, pattern.budget):
                best = pattern.best(text[low:high])
                if best:
                    end = low + best[1]
                    place = (best[0], pattern.begin(text, end), end)
                    places[item_id] = min(places.get(item_id, place), place)
        return found[False] | found[True]


def spans(starts: set[int], n: int, budget: int) -> list[list[int]]:
    """The parts of a text around these starts of a pattern; parts that meet are one."""
    out: list[list[int]] = []
    for start in sorted(starts):
        low, high = max(0, start - budget), start + n + budget
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return out


def item_blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The normalised items in blocks of about `block_chars`, fetched one partition at a time."""
    block, size = [], 0
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    for item_id, text in rows.where("item_id IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        text = normalised(text)
        if not text:
            continue
        block.append((item_id, text))
        size += len(text)
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    rate: float = RATE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id, edits, start, end): each test item that a document holds, at its best place.

    Positions are those of the normalised text. `rate` is the edits allowed per character.
    Every item is looked for; one that is too short for an edit (16 characters at 6 in a hundred) is
    found word for word. Null texts are empty, and an item without a letter or digit has nothing to look
    for. Repeated document rows give repeated results; items that repeat an item_id count as one. Without
    items or documents there are no rows.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for block in item_blocks(items, block_chars):

        def run(batches, block=block) -> Iterator:
            import pyarrow as pa

            matcher = Matcher(block, rate)
            for batch in batches:
                rows = []
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    rows += [(d, i, *place) for i, place in matcher.leaks(normalised(t)).items()]
                if rows:
                    columns = list(zip(*rows))
                    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, types)],
                        ["doc_id", "item_id", "edits", "start", "end"],
                    )

        part = source.mapInArrow(run, LEAKS)
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], LEAKS) if out is None else out


def without_leaks(
    docs: DataFrame, items: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """The documents that hold no test item; all columns. Rows without a doc_id are judged by text too."""
    source = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string"))
    kind = source.schema["row"].dataType.simpleString()
    for block in item_blocks(items, block_chars):

        def run(batches, block=block) -> Iterator:
            import pyarrow as pa

            matcher = Matcher(block, rate)
            for batch in batches:
                clean = [not matcher.leaks(normalised(t)) for t in batch.column(1).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        source = source.mapInArrow(run, f"row {kind}, text string")
    return source.select(*[F.col("row")[c].alias(c) for c in docs.columns])
