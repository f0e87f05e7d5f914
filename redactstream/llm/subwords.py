"""Token ids of whole texts with a public tokenizer file, each distinct word encoded once.

The tokenizer changes characters one by one and its words never hold white space, so the
ids of a text are those of its chunks between ASCII white space, one after another; and in
a chunk of plain letters, digits and signs they are those of the runs the tokenizer's split
rule makes. A task finds these words with array operations over the bytes of many texts,
encodes each distinct word once with the tokenizers library and copies its ids to every
place. Chunks with an apostrophe or any character beyond Latin-1 letters are one word here.
Words are looked up by 64-bit hashes and told apart by their bytes (beyond 16 bytes, by length and
a cryptographic digest); a word that shares another's hash is encoded anew each time.
"""

from __future__ import annotations

import os

WORD_END = "</w>"
JOINED_WORDS = 20_000
SLICE_CHARS = 2_000_000
KNOWN_WORDS = 500_000
TABLE_BITS = 21


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Subwords:
    """Encodes slices of texts. One per task; its memory is bounded by KNOWN_WORDS."""

    def __init__(self, path: str, known_words: int = KNOWN_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        from redactstream.llm.words import fold, word_keys

        self.np, self.fold, self.word_keys = np, fold, word_keys
        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith(WORD_END)]] = True
        # The same merges for words that are lower-cased and split already.
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(False, use_regex=False)]
        )
        # Byte classes: 0 white space, 1 letter, 2 digit, 3 sign, 4 encode the chunk whole.
        kind = np.full(256, 4, np.uint8)
        kind[[9, 10, 11, 12, 13, 32]] = 0
        kind[33:127] = 3
        kind[ord("'")] = 4
        for first, last, k in (("a", "z", 1), ("A", "Z", 1), ("0", "9", 2)):
            kind[ord(first) : ord(last) + 1] = k
        self.kind = kind
        if not self.ends.any():  # another kind of tokenizer: nothing is known of its words
            kind[kind > 0] = 4
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        self.lower = lower
        self.known_words = known_words
        self._forget()

    def _forget(self) -> None:
        np = self.np
        self.hashes = np.zeros(1, np.uint64)
        # First and second number of the word's key, and its length with the kind.
        self.keys = [np.zeros(1, np.uint64)] * 3
        self.sorted = np.zeros(1, np.uint64)
        self.order = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)
        self.size = np.zeros(1, np.int64)
        self.table = np.zeros(1 << TABLE_BITS, np.int32)

    def _ids(self, words: list[str], joined: bool):
        """Flat ids and ids per word."""
        np = self.np
        flats, sizes = [], []
        for k in range(0, len(words), JOINED_WORDS):
            part = words[k : k + JOINED_WORDS]
            if joined:
                (e,) = self.merges.encode_batch_fast([" ".join(part)], add_special_tokens=False)
                ids = np.array(e.ids, np.uint32)
                stops = np.flatnonzero(self.ends[ids]) + 1
                if len(stops) == len(part):
                    flats.append(ids)
                    sizes.append(np.diff(stops, prepend=0))
                    continue
            encoded = [e.ids for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
            sizes.append(np.array([len(x) for x in encoded], np.int64))
            flats.append(np.fromiter((i for x in encoded for i in x), np.uint32))
        return np.concatenate(flats), np.concatenate(sizes)

    def _learn(self, hashes, keys, words: list[str], joined: bool) -> None:
        np = self.np
        if not words:
            return
        ids, size = self._ids(words, joined)
        first = len(self.hashes)
        at = len(self.flat) + np.cumsum(size) - size
        self.hashes = np.concatenate([self.hashes, hashes])
        self.keys = [np.concatenate([old, new]) for old, new in zip(self.keys, keys)]
        self.at, self.size = np.concatenate([self.at, at]), np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, ids])
        self.table[(hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = np.arange(
            first, len(self.hashes), dtype=np.int32
        )
        self.order = np.argsort(self.hashes)
        self.sorted = self.hashes[self.order]

    @staticmethod
    def _words(data, begin, end) -> list[str]:
        raw = data.tobytes()
        return [raw[i:j].decode() for i, j in zip(begin.tolist(), end.tolist())]

    def _find(self, h):
        """Places of the hashes among the known words, -1 where unknown."""
        np = self.np
        k = self.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)].astype(np.int64)
        off = np.flatnonzero((self.hashes[k] != h) | (k == 0))
        if len(off):
            at = np.minimum(np.searchsorted(self.sorted, h[off]), len(self.sorted) - 1)
            k[off] = np.where(self.sorted[at] == h[off], self.order[at], -1)
        return k

    def encode(self, texts: list):
        """Ids of all texts, one after another, and where each text's ids start (one more entry ends them)."""
        np = self.np
        raw = [t.encode() if t else b"" for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        doc_at = np.cumsum([0] + [len(b) + 1 for b in raw])
        kind, low = self.kind[data], self.lower[data]
        lead = np.flatnonzero(data == 0xC3)  # letters À to ÿ, but for the two signs among them
        if len(lead) and self.ends.any():
            second = data[lead + 1]
            lead = lead[(second != 0x97) & (second != 0xB7)]
            second = data[lead + 1]
            kind[lead] = kind[lead + 1] = 1
            low[lead + 1] = np.where(second < 0x9F, second + 32, second)
        # A special token's string counts anywhere in a text; its chunk is encoded whole.
        kind[np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))] = 4
        odd = np.flatnonzero(kind == 4)
        if len(odd):
            gap = np.flatnonzero(kind == 0)
            start = np.concatenate([[0], gap + 1])
            of = np.unique(np.searchsorted(gap, odd))
            size = gap[of] - start[of]
            where = np.repeat(start[of] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            kind[where] = 4
            low[where] = data[where]
        change = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == 2)) + 1
        edge = np.concatenate([[0], change, [len(data)]])
        begin, end = edge[:-1], edge[1:]
        real = kind[begin] > 0
        begin, end = begin[real], end[real]
        first, second = self.word_keys(low, begin, end)
        # A word of the same bytes is encoded alike only within its kind.
        sized = (end - begin).astype(np.uint64) * np.uint64(2) + (kind[begin] == 4)
        h = self.fold(first, second, sized)
        place = self._find(h)
        if (place < 0).any():
            if len(self.hashes) > self.known_words:
                self._forget()
                place[:] = -1
            miss = np.flatnonzero(place < 0)
            new, at = np.unique(h[miss], return_index=True)
            at = miss[at]
            whole, words = kind[begin[at]] == 4, self._words(low, begin[at], end[at])
            keys = np.stack([first[at], second[at], sized[at]])
            for joined, pick in ((True, np.flatnonzero(~whole)), (False, np.flatnonzero(whole))):
                self._learn(new[pick], keys[:, pick], [words[i] for i in pick.tolist()], joined)
            place[miss] = self._find(h[miss])
        known_at, known_size, flat = self.at[place], self.size[place], self.flat
        same = (self.keys[0][place] == first) & (self.keys[2][place] == sized)
        wide = np.flatnonzero(sized > 17)  # longer than 8 bytes
        same[wide] &= self.keys[1][place[wide]] == second[wide]
        other = np.flatnonzero(~same)
        if len(other):
            whole, words = kind[begin[other]] == 4, self._words(low, begin[other], end[other])
            for joined, pick in ((True, np.flatnonzero(~whole)), (False, np.flatnonzero(whole))):
                if len(pick):
                    ids, size = self._ids([words[i] for i in pick.tolist()], joined)
                    known_at[other[pick]] = len(flat) + np.cumsum(size) - size
                    known_size[other[pick]] = size
                    flat = np.concatenate([flat, ids])
        size = known_size
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        ids = flat[np.repeat(known_at - (stop - size), size) + np.arange(total)]
        before = np.concatenate([[0], stop])
        return ids.astype("<u4"), before[np.searchsorted(begin, doc_at)]


def text_slices(texts: list, most: int = SLICE_CHARS):
    """Index ranges of consecutive texts of about `most` characters; a longer text may end one."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
