"""Word-level BPE with an end-of-word suffix, merged rank by rank over ragged numpy arrays.

A vocabulary file of the ``tokenizers`` library (BPE model, byte-level symbols, ``</w>`` on the last symbol of a
word) is read once per Python worker. A slice of texts is cut into pre-tokens by array operations on code points;
each distinct pre-token is encoded once per worker (bounded memo, found by a 64-bit hash and held against its
characters), and a text's tokens are those of its pre-tokens. The library serves as a table of Unicode versions alone:
it says how code points count that this Python does not know.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np

from hexlore.llm.hashing import cut_mask, hash_runs, windows

#: Pre-tokens with more symbols than this are merged one by one, with work for the places that a merge touches only.
LONG_WORD = 4096
#: Pre-tokens of up to so many bytes are remembered in arrays, longer ones by themselves.
SHORT = 64
#: Longer pre-tokens are not remembered beyond their slice, and bytes that a worker remembers of those by themselves.
MEMO_LONGEST, MEMO_BYTES = 4096, 30_000_000
#: Distinct pre-tokens that a worker remembers before it starts afresh.
MEMO_WORDS = 1_500_000
#: The only pre-tokenizer pattern that this module knows, and its contractions.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: White space beyond the categories Zs, Zl and Zp.
SPACES = "\t\n\x0b\x0c\r\x85"
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [chr(rest.get(b, b)) for b in range(256)]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """SPACE, LETTER, NUMBER or OTHER for each code point; UNKNOWN where Unicode versions may differ."""
    kind = {"L": LETTER, "N": NUMBER, "Z": SPACE}
    out = np.fromiter((UNKNOWN if (c := unicodedata.category(chr(cp))) == "Cn" else kind.get(c[0], OTHER) for cp in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[[ord(c) for c in SPACES]] = SPACE
    return out


class WordBpe:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"]
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if pattern != PATTERN:
            raise ValueError(f"unknown pre-tokenizer pattern {pattern!r}")
        signs = byte_symbols()
        self.inner = np.array([vocab[s] for s in signs], np.int64)
        self.last = np.array([vocab[s + suffix] for s in signs], np.int64)
        self.byte_of = {s: b for b, s in enumerate(signs)}
        self.width = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        born = np.full(self.width, -1, np.int64)
        born[made[::-1]] = np.arange(len(pairs))[::-1]
        # A merge may only use symbols made before it: then no merge makes a pair of lower rank than its own.
        self.ordered = bool((born[left] < np.arange(len(pairs))).all() and (born[right] < np.arange(len(pairs))).all() and len(set(made.tolist())) == len(pairs))
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of, self.made = keys[order], order.astype(np.int64), made
        self.none = len(pairs)
        if not self.ordered:
            raise ValueError("merging by rank needs merges that build on earlier ones")
        self.foreign: dict[int, int] = {}
        self.reset()

    def reset(self) -> None:
        self.hashes, self.numbers = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.ids = np.array(list(self.special.values()), np.uint32)
        self.counts = np.ones(len(self.special), np.int64)
        self.starts = np.arange(len(self.special), dtype=np.int64)
        # The bytes behind the numbers, eight to an element; none for what is not a short word.
        self.chunks = np.empty(0, np.uint64)
        self.chunk_starts, self.sizes = np.zeros(len(self.special), np.int64), np.zeros(len(self.special), np.int64)
        self.singles: dict[bytes, int] = {}
        self.single_bytes = 0

    def kind_of(self, code: int) -> int:
        """The class of a code point that Python's Unicode version does not know, as the library sees it."""
        if code not in self.foreign:
            c = chr(code)
            cut = lambda text: [text[i:j] for _, (i, j) in self.library.pre_tokenizer.pre_tokenize_str(text)]
            between = cut(f"a{c}a")
            self.foreign[code] = LETTER if len(between) == 1 else SPACE if len(between) == 2 else OTHER if len(cut(c + c)) == 1 else NUMBER
        return self.foreign[code]

    def normal(self, text: str) -> str:
        if not text.isascii():
            # Lower-casing here is by single character: the final form of sigma is not special.
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        return text.lower()

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        starts = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        self.counts = np.concatenate([self.counts, counts])
        self.starts = np.concatenate([self.starts, starts])

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], self.none)

    def merge(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges ragged sequences (flat symbols, sizes) until no pair is left; rounds are synchronous over all sequences.

        In each round every sequence applies its own lowest-rank pair at all places, left to right.
        """
        done_flat: list[np.ndarray] = []
        done_row: list[np.ndarray] = []
        alive = np.arange(len(size))
        row = np.repeat(alive, size)
        rank = np.full(len(flat), self.none, np.int64)
        if len(flat) > 1:
            inside = np.flatnonzero(row[:-1] == row[1:])
            rank[inside] = self.ranks(flat[inside], flat[inside + 1])
        while len(alive):
            least = np.minimum.reduceat(rank, np.cumsum(size) - size)
            over = least == self.none
            if over.any():
                gone = over[row]
                done_flat.append(flat[gone])
                done_row.append(alive[row[gone]])
                flat, rank = flat[~gone], rank[~gone]
                alive, size, least = alive[~over], size[~over], least[~over]
                row = np.repeat(np.arange(len(size)), size)
                if not len(alive):
                    break
            spot = np.flatnonzero(rank == least[row])
            # In a run of overlapping hits (x x x) every other one counts, from the left.
            at = np.arange(len(spot))
            run_start = np.r_[True, (np.diff(spot) > 1) | (row[spot][1:] != row[spot][:-1])]
            spot = spot[(at - np.maximum.accumulate(np.where(run_start, at, 0))) % 2 == 0]
            flat[spot] = self.made[rank[spot]]
            keep = np.ones(len(flat), bool)
            keep[spot + 1] = False
            size = size - np.bincount(row[spot], minlength=len(size))
            spot = spot - np.arange(len(spot))
            flat, rank, row = flat[keep], rank[keep], row[keep]
            # Only the pairs next to a merged symbol have changed.
            near = np.r_[spot, spot[spot > 0] - 1]
            rank[near] = self.none
            near = near[near + 1 < len(flat)]
            near = near[row[near] == row[near + 1]]
            rank[near] = self.ranks(flat[near], flat[near + 1])
        if not done_flat:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        rows, out = np.concatenate(done_row), np.concatenate(done_flat)
        order = np.argsort(rows, kind="stable")
        return out[order], rows[order]

    def merge_long(self, flat: np.ndarray) -> np.ndarray:
        """merge() for one long sequence: ranks in rising order, each at all its places at once, left to right.

        Merges build on earlier ones, so no rank comes back that is done with; neighbours are linked, so a merge costs
        the places that it touches.
        """
        n = len(flat)
        symbol, after, before = flat.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.r_[self.ranks(flat[:-1], flat[1:]), self.none]
        due: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def note(places: np.ndarray) -> None:
            places = places[rank[places] < self.none]
            places = places[np.argsort(rank[places], kind="stable")]
            values, begins = np.unique(rank[places], return_index=True)
            for r, own in zip(values.tolist(), np.split(places, begins[1:]), strict=len(values) > 0):
                if r not in due:
                    due[r] = []
                    heapq.heappush(ranks, r)
                due[r].append(own)

        note(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            spot = np.unique(np.concatenate(due.pop(r)))
            spot = spot[rank[spot] == r]
            if not len(spot):
                continue
            at = np.arange(len(spot))
            run_start = np.r_[True, after[spot[:-1]] != spot[1:]]
            spot = spot[(at - np.maximum.accumulate(np.where(run_start, at, 0))) % 2 == 0]
            gone = after[spot]
            beyond = after[gone]
            symbol[spot], symbol[gone], rank[gone] = self.made[r], -1, self.none
            after[spot] = beyond
            before[beyond[beyond < n]] = spot[beyond < n]
            near = np.unique(np.r_[spot, before[spot]])
            near = near[near >= 0]
            rank[near] = self.none
            near = near[after[near] < n]
            rank[near] = self.ranks(symbol[near], symbol[after[near]])
            note(near)
        return symbol[symbol >= 0]

    def learn(self, raw: list[bytes]) -> None:
        """Encodes words and numbers them on."""
        if not raw:
            return
        size = np.array([len(r) for r in raw], np.int64)
        octets = np.frombuffer(b"".join(raw), np.uint8)
        flat = self.inner[octets]
        ends = np.cumsum(size)
        flat[ends - 1] = self.last[octets[ends - 1]]
        if (size <= LONG_WORD).all():
            ids, rows = self.merge(flat, size)
            self.add(ids, np.bincount(rows, minlength=len(raw)))
            return
        short = np.flatnonzero(size <= LONG_WORD)
        ids, rows = self.merge(flat[np.repeat(size <= LONG_WORD, size)], size[short])
        done = dict(zip(short.tolist(), np.split(ids, np.searchsorted(rows, np.arange(1, len(short)))), strict=True)) if len(short) else {}
        done |= {k: self.merge_long(flat[ends[k] - size[k] : ends[k]]) for k in np.flatnonzero(size > LONG_WORD).tolist()}
        parts = [done[k] for k in range(len(raw))]
        self.add(np.concatenate(parts), np.array([len(p) for p in parts], np.int64))

    def remember(self, eights: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        """Notes the bytes of the short words numbered last."""
        n = (size + 7) // 8
        ends = np.cumsum(n)
        flat = eights[np.repeat(first - 8 * (ends - n), n) + 8 * np.arange(ends[-1])]
        flat[ends - 1] &= cut_mask(size - 8 * (n - 1))
        self.chunk_starts = np.concatenate([self.chunk_starts, len(self.chunks) + ends - n])
        self.sizes = np.concatenate([self.sizes, size])
        self.chunks = np.concatenate([self.chunks, flat])

    def same(self, eights: np.ndarray, first: np.ndarray, size: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Whether words (places, sizes) that share the hashes of the numbered ones have their bytes too.

        Up to eight bytes the size settles it, as hashes of runs that short and of one size are all different.
        """
        out = self.sizes[number] == size
        left, at = np.flatnonzero(out & (size > 8)), 0
        while len(left):
            own, rest = eights[first[left] + 8 * at], size[left] - 8 * at
            own &= cut_mask(rest)
            out[left[own != self.chunks[self.chunk_starts[number[left]] + at]]] = False
            left, at = left[rest > 8], at + 1
        return out

    def numbers_of(self, octets: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The numbers of words (places among the bytes), new ones being encoded first."""
        out, size = np.empty(len(first), np.int64), last - first
        short = np.flatnonzero(size <= SHORT)
        single = size > SHORT
        word = lambda k: octets[first[k] : last[k]].tobytes()
        if len(short):
            eights = windows(octets)
            hashes = hash_runs(octets, first[short], last[short], eights)
            uniq, where, back = np.unique(hashes, return_index=True, return_inverse=True)
            at = np.searchsorted(self.hashes, uniq)
            known = np.zeros(len(uniq), bool)
            known[at < len(self.hashes)] = self.hashes[at[at < len(self.hashes)]] == uniq[at < len(self.hashes)]
            fresh = np.flatnonzero(~known)
            if len(fresh):
                base, made = len(self.counts), short[where[fresh]]
                self.learn([word(k) for k in made.tolist()])
                self.remember(eights, first[made], size[made])
                self.numbers = np.insert(self.numbers, at[fresh], base + np.arange(len(fresh)))
                self.hashes = np.insert(self.hashes, at[fresh], uniq[fresh])
                at = np.searchsorted(self.hashes, uniq)
            out[short] = self.numbers[at][back]
            # A word that only shares the hash of another goes by itself.
            single[short[~self.same(eights, first[short], size[short], out[short])]] = True
        rest = np.flatnonzero(single)
        if len(rest):
            words = [word(k) for k in rest.tolist()]
            fresh = [w for w in dict.fromkeys(words) if w not in self.singles]
            base = len(self.counts)
            self.learn(fresh)
            self.chunk_starts = np.concatenate([self.chunk_starts, np.zeros(len(fresh), np.int64)])
            self.sizes = np.concatenate([self.sizes, np.zeros(len(fresh), np.int64)])
            now = {w: base + k for k, w in enumerate(fresh)}
            out[rest] = [now[w] if w in now else self.singles[w] for w in words]
            self.singles.update((w, n) for w, n in now.items() if len(w) <= MEMO_LONGEST)
            self.single_bytes += sum(map(len, fresh))
        return out

    def numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of the texts, in order, and how many each text has.

        Afterwards counts, starts and ids hold for those numbers; the first numbers are the special tokens.
        """
        if len(self.hashes) > MEMO_WORDS or self.single_bytes > MEMO_BYTES:
            self.reset()
        kinds = classes()
        parts: list[str] = []
        owner: list[int] = []
        raw: list[str] = []
        marks: list[tuple[int, int]] = []  # a part that stands for one special token
        names = list(self.special)
        for k, text in enumerate(texts):
            for cut in self.special_split.split(text) if self.special_split and "<|" in text else (text,):
                if cut in self.special:
                    marks.append((len(parts), names.index(cut)))
                    parts.append(" ")
                else:
                    parts.append(self.normal(cut) + " ")
                raw.append(cut)
                owner.append(k)
        joined = "".join(parts)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = kinds[code]
        if (kind == UNKNOWN).any():
            ends = np.cumsum([len(p) for p in parts])
            for p in np.unique(np.searchsorted(ends, np.flatnonzero(kind == UNKNOWN), "right")).tolist():
                parts[p] = self.library.normalizer.normalize_str(raw[p]) + " "
            joined = "".join(parts)
            code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            kind = kinds[code]
            odd = np.flatnonzero(kind == UNKNOWN)
            codes, back = np.unique(code[odd], return_inverse=True)
            kind[odd] = np.array([self.kind_of(c) for c in codes.tolist()], np.uint8)[back]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        start = kind != SPACE
        same = (kind[1:] == kind[:-1]) & (kind[1:] != NUMBER)
        start[1:] &= ~same
        self.contract(code, kind, start)
        first = np.flatnonzero(start)
        # A word ends before the next start or the next space.
        stop = start | (kind == SPACE)
        stops = np.flatnonzero(stop)
        last = np.r_[stops, len(code)][np.searchsorted(stops, first, "right")]
        octets = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        # Where each code point is among the bytes.
        spot = np.arange(len(code) + 1) if len(octets) == len(code) else np.r_[0, np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), dtype=np.int64)]
        number = self.numbers_of(octets, spot[first], spot[last]) if len(first) else np.empty(0, np.int64)
        begin = np.cumsum(sizes) - sizes
        per_part = np.diff(np.r_[np.searchsorted(first, begin), len(first)])
        if marks:
            place = np.searchsorted(first, begin[[p for p, _ in marks]])
            number = np.insert(number, place, [n for _, n in marks])
            per_part[[p for p, _ in marks]] += 1
        return number, np.bincount(owner, weights=per_part, minlength=len(texts)).astype(np.int64)

    def contract(self, code: np.ndarray, kind: np.ndarray, start: np.ndarray) -> None:
        """Joins a lone apostrophe that begins a pre-token with the contraction that follows it."""
        spot = np.flatnonzero((code == ord("'")) & start)
        spot = spot[spot + 1 < len(code)]
        spot = spot[kind[spot + 1] == LETTER]
        open_ = np.ones(len(spot), bool)
        for tail in CONTRACTIONS:
            hit = open_ & (spot + len(tail) < len(code))
            for k, letter in enumerate(tail, 1):
                hit[hit] = code[spot[hit] + k] == ord(letter)
            open_ &= ~hit
            after = spot[hit] + 1
            start[after] = False
            after = after + len(tail)
            after = after[after < len(code)]
            start[after] |= kind[after] == LETTER

    def token_counts(self, texts: list[str]) -> np.ndarray:
        number, n_words = self.numbered(texts)
        sums = np.r_[0, np.cumsum(self.counts[number])]
        ends = np.cumsum(n_words)
        return sums[ends] - sums[ends - n_words]

    def token_ids(self, texts: list[str]) -> list[np.ndarray]:
        number, n_words = self.numbered(texts)
        size = self.counts[number]
        ends = np.cumsum(size)
        flat = self.ids[np.repeat(self.starts[number] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return np.split(flat, np.r_[0, ends][np.cumsum(n_words)][:-1]) if len(texts) else []


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    return WordBpe(path)
