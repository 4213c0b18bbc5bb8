"""The ids of a public word-level BPE file, chunk by chunk.

The file's normaliser and pre-tokeniser never join text across white space, and its special tokens hold none, so the
ids of a text are those of its white-space chunks in a row. Each worker keeps bounded memos of chunks and of words.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

from cytoplane.llm.common import MEMO_ENTRIES, Memo, chunks

FILE = "word_bpe_49k.json"
#: Bytes of a word up to which its pairs are looked through at every merge.
SHORT = 40
#: A character between chunks that is no id.
BREAK = chr(0x10FFFF)
_OLD = unicodedata.ucd_3_2_0


def vocabulary_path(name: str = FILE) -> str:
    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Merger:
    """Ids of single words by ranked merges, and the strings of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.added).items()}
        pairs = (tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"])
        self.ranks = {self.vocab[a] << 20 | self.vocab[b]: (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        letters = byte_letters()
        self.inner = [self.vocab[x] for x in letters]
        self.last = [self.vocab[x + self.suffix] for x in letters]
        pairs = sorted((key, rank, new) for key, (rank, new) in self.ranks.items())
        self._keys = np.array([key for key, _, _ in pairs], np.int64)
        self._rank = np.array([rank for _, rank, _ in pairs], np.int64)
        self._new = np.zeros(len(pairs) + 1, np.int64)
        self._new[self._rank] = [new for _, _, new in pairs]

    def ids(self, word: bytes) -> list[int]:
        """Merge the pair of lowest rank, the leftmost of equals, until none is left."""
        inner = self.inner
        ids = [inner[b] for b in word]
        ids[-1] = self.last[word[-1]]
        if len(ids) > SHORT:
            return self._long(ids)
        get, none = self.ranks.get, (1 << 60, 0)
        found = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is none:
                break
            at = found.index(best)
            ids[at] = best[1]
            del ids[at + 1], found[at]
            if at < len(found):
                found[at] = get(ids[at] << 20 | ids[at + 1], none)
            if at:
                found[at - 1] = get(ids[at - 1] << 20 | ids[at], none)
        return ids

    def many(self, words: list[bytes]) -> list[list[int]]:
        """The same for many words at once: in each round every word that can takes its next merge."""
        out: list[list[int]] = [[] for _ in words]
        short = []
        for k, w in enumerate(words):
            if len(w) > SHORT:
                out[k] = self.ids(w)
            elif w:
                short.append(k)
        if not short:
            return out
        sizes = np.array([len(words[k]) for k in short])
        letters = np.frombuffer(b"".join([words[k] for k in short]), np.uint8)
        ids, ends = np.array(self.inner)[letters], np.cumsum(sizes) - 1
        ids[ends] = np.array(self.last)[letters[ends]]
        owner = np.repeat(np.arange(len(short)), sizes)
        none = len(self._keys)

        def rank_of(at: np.ndarray) -> np.ndarray:
            """Rank of the pair that begins at each place; ``none`` at the last id of a word."""
            to = np.minimum(at + 1, len(ids) - 1)
            key = ids[at] << 20 | ids[to]
            k = np.minimum(np.searchsorted(self._keys, key), none - 1)
            return np.where((self._keys[k] == key) & (owner[at] == owner[to]) & (to > at), self._rank[k], none)

        rank = rank_of(np.arange(len(ids))) if none else np.full(len(ids), none)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(rank, first)
            wide = np.repeat(best, np.diff(first, append=len(ids)))
            over = wide == none
            if over.any():
                done.append((owner[over], ids[over]))
                live = ~over
                ids, owner, rank, wide = ids[live], owner[live], rank[live], wide[live]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == wide)
            at = hit[np.diff(owner[hit], prepend=-1) != 0]
            ids[at] = self._new[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            rank[at] = rank_of(at)
            before = at[at > 0] - 1
            rank[before] = rank_of(before)
        owner = np.concatenate([x for x, _ in done])
        order = np.argsort(owner, kind="stable")
        flat, to = np.concatenate([x for _, x in done])[order].tolist(), 0
        for k, n in zip(short, np.bincount(owner, minlength=len(short)).tolist(), strict=True):
            out[k], to = flat[to : to + n], to + n
        return out

    def _long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs, for words whose pairs are too many to look through at every step."""
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(got[0], at, got[1]) for at in range(n - 1) if (got := ranks.get(ids[at] << 20 | ids[at + 1]))]
        heapq.heapify(heap)
        while heap:
            _, at, new = heapq.heappop(heap)
            to = after[at]
            if ids[at] < 0 or to >= n or ranks.get(ids[at] << 20 | ids[to], (0, -1))[1] != new:
                continue
            ids[at], ids[to] = new, -1
            after[at] = nxt = after[to]
            if nxt < n:
                before[nxt] = at
                if got := ranks.get(new << 20 | ids[nxt]):
                    heapq.heappush(heap, (got[0], at, got[1]))
            if (prev := before[at]) >= 0 and (got := ranks.get(ids[prev] << 20 | new)):
                heapq.heappush(heap, (got[0], prev, got[1]))
        return [x for x in ids if x >= 0]


class Words:
    """The file's normaliser and pre-tokeniser: words of a text as bytes, or ids where they are known at once.

    These are special tokens, and all of a text with characters younger than Unicode 3.2: what is a letter then depends
    on the Unicode version, so such a text goes to the file's library, if ``path`` names the file.
    """

    def __init__(self, added: dict[str, int], path: str | None = None):
        self.added, self.path, self.library = added, path, None
        names = sorted(map(regex.escape, added), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(names) + ")") if names else None
        # Fixed value: the pattern of the public file.
        self.word = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.line = regex.compile(self.word.pattern + r"|\n")

    def many(self, parts: Iterable[str]) -> tuple[list[str], list[str], list[str]]:
        """The plain ones of these chunks, their words in a row with a line feed between chunks, and the other chunks,
        which hold special tokens or younger characters and are to be looked at one by one."""
        plain = list(parts)
        text, odd = "\n".join(plain), ""
        if self.path and not text.isascii():
            odd = "".join(regex.escape(c) for c in set(text) if _OLD.category(c) == "Cn")
        marks = [f"[{odd}]"] if odd else []
        marks += [regex.escape(x) for x in self.added if x in text]
        rest: list[str] = []
        if marks:
            found = regex.compile("|".join(marks)).search
            rest = [x for x in plain if found(x)]
            plain = [x for x in plain if not found(x)]
            text = "\n".join(plain)
        return plain, self.line.findall(self.plain(text)), rest

    def __call__(self, text: str) -> list[bytes | int]:
        """The words of one text of any kind."""
        if self.path and not text.isascii() and any(_OLD.category(c) == "Cn" for c in text):
            if self.library is None:
                self.library = Tokenizer.from_file(self.path)
                self.library.no_truncation()
                self.library.no_padding()
            return self.library.encode(text, add_special_tokens=False).ids
        if self.special is None or not any(x in text for x in self.added):
            return [x.encode() for x in self.word.findall(self.plain(text))]
        out: list[bytes | int] = []
        for part in self.special.split(text):
            out += [self.added[part]] if part in self.added else [x.encode() for x in self.word.findall(self.plain(part))]
        return out

    @staticmethod
    def plain(text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        # Letter by letter: the file does not look at what follows a capital sigma.
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


class ChunkIds:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    Memos hold ids as characters of those numbers, so that texts are joined as strings and turned into bytes once.
    """

    def __init__(self, path: str, entries: int = 2 * MEMO_ENTRIES):
        self.merger = Merger(path)
        self.words = Words(self.merger.added, path)
        self.by_word, self.memo = Memo(self._word, entries), Memo(self._chunk, entries)

    def _word(self, word: str) -> str:
        return "".join(map(chr, self.merger.ids(word.encode())))

    def _chunk(self, chunk: str) -> str:
        return "".join([chr(w) if isinstance(w, int) else self.by_word[w.decode()] for w in self.words(chunk)])

    def encode(self, texts: list[str]) -> list[bytes]:
        self.memo.trim()
        self.by_word.trim()
        parts = [chunks(x) for x in texts]
        # Chunks with special tokens or younger characters are left to the memo itself.
        plain, words, _ = self.words.many(self.memo.missing(set().union(*parts)))
        new = self.by_word.missing(set(words) - {"\n"})
        self.by_word.update(zip(new, ["".join(map(chr, x)) for x in self.merger.many([w.encode() for w in new])], strict=True))
        if plain:
            of = dict.fromkeys(["\n"], BREAK) | {w: self.by_word[w] for w in set(words) - {"\n"}}
            self.memo.update(zip(plain, "".join(map(of.__getitem__, words)).split(BREAK), strict=True))
        get = self.memo.__getitem__
        return ["".join(map(get, x)).encode("utf-32-le", "surrogatepass") for x in parts]
