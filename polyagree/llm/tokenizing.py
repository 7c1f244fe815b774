"""Whole texts to token ids with a byte-level BPE file of the `tokenizers` library, a block of texts at a time.

A byte-level BPE splits a text into pieces before it merges, so ids of a text are the ids of its pieces in a row. The pieces
of a block are found from the classes of its characters, and alike ones are one; those that a worker does not remember are
merged all at once in numpy (`Merger`). Pieces count as alike by a hash and then by their bytes. Texts with characters whose
class is not beyond doubt, or with a special token, go to the library whole; ids equal the library's for whole texts. What a
worker remembers is bounded, and no Python object is made for a word or a text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import numpy as np

from . import shared

#: Where a long text may be parted: before a space between ASCII letters, where a piece begins.
BETWEEN = re.compile(rb"(?<=[A-Za-z]) (?=[A-Za-z])")
#: Pieces that a worker remembers, and bytes above which one is not remembered and goes to the library.
REMEMBERED, LONGEST = 1 << 19, 40
#: Bytes of texts that are cut together, and bytes above which a text is parted.
BLOCK, PARTED = 1 << 20, 2 << 20
#: Pieces merged at once.
ROWS = 1 << 14
LETTER, DIGIT, MARK, SPACE, OTHER_SPACE, DOUBT = range(6)


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it shows, else one of those after U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def classes() -> np.ndarray:
    """The class of each character below U+20000. In doubt: what old and new Unicode tell apart, and white space beyond ASCII's six."""
    out = np.full(1 << 17, DOUBT, np.uint8)
    for i in range(len(out)):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind == unicodedata.ucd_3_2_0.category(c) and kind != "Cn" and kind[0] != "Z" and not c.isspace() and kind not in ("Cs", "Cf"):
            out[i] = LETTER if kind[0] == "L" else DIGIT if kind[0] == "N" else MARK
    out[[9, 10, 11, 12, 13]], out[32] = OTHER_SPACE, SPACE
    out[[0x85, 0x180E]] = DOUBT
    return out


def spread(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of runs of `counts` from `begins`, end to end."""
    ends = np.cumsum(counts)
    return np.repeat(begins - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)


class Merger:
    """Merges the bytes of many pieces at once: in each round, every piece joins its pair of the lowest rank, the leftmost of equals."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.kind = np.uint16 if max(len(pairs), *vocabulary.values()) < 0xFFFF else np.uint32
        self.none = self.kind(np.iinfo(self.kind).max)  # the rank of what is no pair
        self.byte = np.array([vocabulary[c] for _, c in sorted(byte_characters().items())], self.kind)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], self.kind)  # by rank
        keys = self.key(np.array([vocabulary[a] for a, _ in pairs]), np.array([vocabulary[b] for _, b in pairs]))
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.ranks = np.zeros(1 << bits, np.uint64), np.full(1 << bits, self.none)
        left, at = np.arange(len(keys)), self.slot(keys)
        while len(left):  # open addressing: each takes the next free slot
            free = left[self.slots[at[left]] == 0]
            taken, first = np.unique(at[free], return_index=True)
            self.slots[taken], self.ranks[taken] = keys[free[first]], free[first]
            left = np.setdiff1d(left, free[first], assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    @staticmethod
    def key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(32)) + b.astype(np.uint64) + np.uint64(1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = self.key(a, b)
        at = self.slot(keys)
        there = self.slots[at]
        out = np.where(there == keys, self.ranks[at], self.none)
        left = np.flatnonzero((there != keys) & (there != 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            there = self.slots[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.ranks[at[left[hit]]]
            left = left[~hit & (there != 0)]
        return out

    def _merged(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, one row a piece; how many in each)."""
        n, width = len(starts), int(sizes.max())
        every = np.arange(width)
        there = every < sizes[:, None]
        ids, ranks = np.zeros((n, width), self.kind), np.full((n, width), self.none)
        ids[there] = self.byte[raw[(starts[:, None] + every)[there]]]
        both = there[:, 1:]
        ranks[:, :-1][both] = self.rank(ids[:, :-1][both], ids[:, 1:][both])
        out, counts, live, left = np.zeros_like(ids), sizes.copy(), np.arange(n), sizes.copy()
        every = every.astype(np.int8 if width < 128 else np.int64)
        while len(live):
            rows, at = np.arange(len(live)), ranks.argmin(axis=1)
            best = ranks[rows, at]
            going = best != self.none
            if not going.all():
                done = ~going
                out[live[done], : ids.shape[1]], counts[live[done]] = ids[done], left[done]
                live, left, at, best = live[going], left[going], at[going], best[going]
                if not len(live):
                    break
                width = int(left.max())
                ids, ranks, rows = ids[going, :width], ranks[going, :width], np.arange(len(live))
            after = every[: ids.shape[1] - 1] > at.astype(every.dtype)[:, None]
            np.copyto(ids[:, :-1], ids[:, 1:].copy(), where=after)
            np.copyto(ranks[:, :-1], ranks[:, 1:].copy(), where=after)
            ranks[:, -1] = self.none
            ids[rows, at] = self.made[best]
            left = left - 1
            ranks[rows, at] = self.none
            some = rows[at + 1 < left]
            ranks[some, at[some]] = self.rank(ids[some, at[some]], ids[some, at[some] + 1])
            some = rows[at > 0]
            ranks[some, at[some] - 1] = self.rank(ids[some, at[some] - 1], ids[some, at[some]])
        return out, counts

    def encode(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of `raw`, end to end, and how many each has."""
        order, found, counts = np.argsort(sizes, kind="stable"), [], np.zeros(len(sizes), np.int64)
        for i in range(0, len(order), ROWS):
            some = order[i : i + ROWS]
            ids, counts[some] = self._merged(raw, starts[some], sizes[some])
            found.append(ids[np.arange(ids.shape[1]) < counts[some][:, None]].astype(kind))
        flat = np.concatenate(found) if found else np.zeros(0, kind)
        begins = np.zeros(len(sizes), np.int64)
        begins[order] = np.cumsum(counts[order]) - counts[order]
        return flat[spread(begins, counts)], counts


class Memory:
    """Ids of pieces by their hash, in arrays; their bytes are kept to tell apart what shares a hash."""

    def __init__(self, kind: np.dtype):
        self.bits = REMEMBERED.bit_length()  # half full at most
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.slots, self.entry, self.n = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32), 0
        self.ids, self.raw = np.zeros(1 << 12, self.kind), np.zeros(1 << 12, np.uint8)
        self.id_at, self.raw_at = np.zeros(1025, np.int64), np.zeros(1025, np.int64)

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 if there is none."""
        at, out, left = self._slot(hashes), np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        while len(left):
            there = self.slots[at[left]]
            hit = there == hashes[left]
            out[left[hit]] = self.entry[at[left[hit]]]
            left = left[~hit & (there != 0)]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, hashes: np.ndarray, raw: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The entries of new pieces with different hashes, bytes and ids end to end."""
        new = self.n + np.arange(len(hashes))
        for name, values in (("ids", ids), ("raw", raw)):
            end = int((self.id_at if name == "ids" else self.raw_at)[self.n])
            self._grow(name, end + len(values))
            getattr(self, name)[end : end + len(values)] = values
        self._grow("id_at", self.n + len(hashes) + 1)
        self._grow("raw_at", self.n + len(hashes) + 1)
        self.id_at[new + 1] = self.id_at[self.n] + np.cumsum(counts)
        self.raw_at[new + 1] = self.raw_at[self.n] + np.cumsum(sizes)
        self.n += len(hashes)
        at, left = self._slot(hashes), np.arange(len(hashes))
        while len(left):
            free = left[self.slots[at[left]] == 0]
            taken, first = np.unique(at[free], return_index=True)
            self.slots[taken], self.entry[taken] = hashes[free[first]], new[free[first]]
            left = np.setdiff1d(left, free[first], assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        return new

    def _grow(self, name: str, size: int) -> None:
        old = getattr(self, name)
        if size > len(old):
            wider = np.zeros(max(size, len(old) * 3 // 2), old.dtype)
            wider[: len(old)] = old
            setattr(self, name, wider)


class Encoder:
    """Ids of texts. `path`: a tokenizers JSON file with a byte-level BPE; others are encoded whole."""

    _made: dict[str, "Encoder"] = {}

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """One for each worker, which keeps what it remembers from task to task."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.code = "H" if self.kind.itemsize == 2 else "I"
        kind = self.tokenizer.pre_tokenizer
        cuts = type(kind).__name__ == "ByteLevel" and self.tokenizer.normalizer is None and not kind.add_prefix_space and kind.use_regex
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.shown = byte_characters()
        self.merger = self._merger(path) if cuts else None
        self.classes = classes() if self.merger else None
        self.memory = Memory(self.kind)
        self.powers = np.ones(1, np.uint64)

    @staticmethod
    def _merger(path: str) -> Merger | None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        return None if model.get("type") != "BPE" or any(model.get(k) for k in odd) else Merger(model["vocab"], model["merges"])

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, self.kind)

    def _piece(self, piece: bytes) -> np.ndarray:
        """Ids of one piece, which goes straight to the library's model."""
        return np.array(array(self.code, [t.id for t in self.tokenizer.model.tokenize(piece.decode("latin-1").translate(self.shown))]), self.kind)

    def _pieces(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `raw` where pieces begin, and for each text whether its characters leave a doubt. Texts are not empty."""
        if raw.max(initial=0) < 128:
            chars, where = raw, None
        else:
            chars = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
            width = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
            where = np.cumsum(width) - width
            if where[-1] + width[-1] != len(raw):  # not UTF-8
                return np.zeros(0, np.int64), np.ones(len(at) - 1, bool)
        first = at[:-1] if where is None else np.searchsorted(where, at[:-1])
        kind = self.classes[chars] if where is None else np.where(chars < len(self.classes), self.classes[np.minimum(chars, len(self.classes) - 1)], np.uint8(DOUBT))
        space = (kind == SPACE) | (kind == OTHER_SPACE)
        begins = np.zeros(len(chars) + 1, bool)  # of texts
        begins[first] = begins[-1] = True
        before_space = np.append(False, space[:-1])
        before_plain = np.append(False, kind[:-1] == SPACE)
        changed = np.append(True, kind[1:] != kind[:-1])
        after = np.append(~space[1:], False) & ~begins[1:]  # a character of another class than white space follows in the text
        starts = np.where(space, ~before_space | after, ~before_plain & changed) | begins[:-1]
        quotes = np.flatnonzero((chars[:-1] == 39) & starts[:-1] & (kind[1:] == LETTER) & ~begins[1:-1]) if len(chars) > 1 else ()
        if len(quotes):  # 's 't 're 've 'm 'll 'd at the begin of a piece are pieces
            one, two = chars[quotes + 1], chars[np.minimum(quotes + 2, len(chars) - 1)]
            inside = (quotes + 2 < len(chars)) & ~begins[np.minimum(quotes + 2, len(chars))]
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = inside & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
            found = quotes[short | long]
            starts[found + 1] = False
            ends = found + 2 + long[short | long]
            ends = ends[ends < len(chars)]
            starts[ends] |= (kind[ends] == LETTER) | begins[ends]
        doubt = np.add.reduceat(kind == DOUBT, first) > 0
        places = np.flatnonzero(starts)
        return places if where is None else where[places], doubt

    def _hashes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit polynomial hashes of pieces from running sums; zero stands for none."""
        if len(self.powers) <= len(raw):  # what a hash is scaled by depends on their number
            self.powers = np.cumprod(np.append(np.uint64(1), np.full(max(len(raw), PARTED), np.uint64(shared._BASE))), dtype=np.uint64)
            self.memory.clear()
        sums = np.append(np.uint64(0), np.cumsum(shared._BYTE_KEY[raw] * self.powers[: len(raw)], dtype=np.uint64))
        h = (sums[ends] - sums[starts]) * self.powers[len(self.powers) - 1 - starts]
        return shared._mixed(h) | np.uint64(1)

    def _block(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and how many each has."""
        counts = np.zeros(len(at) - 1, np.int64)
        full = np.flatnonzero(np.diff(at) > 0)
        if not len(full):
            return np.zeros(0, self.kind), counts
        text, edges = raw.tobytes(), np.append(at[full], at[-1])
        if self.merger:
            starts, doubt = self._pieces(raw, edges)
        else:
            starts, doubt = np.zeros(0, np.int64), np.ones(len(full), bool)
        for special in self.special:
            place = text.find(special)
            while place >= 0:
                doubt[np.searchsorted(edges, place, side="right") - 1] = True
                place = text.find(special, place + 1)
        ends = np.append(starts[1:], len(raw))
        of = np.searchsorted(edges, starts, side="right") - 1
        if doubt.any():
            sure = ~doubt[of]
            starts, ends, of = starts[sure], ends[sure], of[sure]
        ids, each = self._ids(raw, starts, ends - starts)
        counts[full] = np.bincount(of, each, minlength=len(full)).astype(np.int64)
        if not doubt.any():
            return ids, counts
        sizes, out, k = counts[full], [], 0
        for i in range(len(full)):
            if doubt[i]:
                out.append(self.whole(text[edges[i] : edges[i + 1]]))
                counts[full[i]] = len(out[-1])
            else:
                out.append(ids[k : k + sizes[i]])
                k += sizes[i]
        return np.concatenate(out), counts

    def _ids(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces end to end, and how many each has."""
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        hashes = self._hashes(raw, starts, starts + sizes)
        order = np.argsort(hashes)
        new = np.append(True, np.diff(hashes[order]) != 0)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        first = order[new]  # one piece of each hash
        same = (sizes == sizes[first][group]).all() and (raw[spread(starts, sizes)] == raw[spread(starts[first][group], sizes)]).all()
        if not same:  # two pieces share a hash
            first, group = np.arange(len(starts)), np.arange(len(starts))
            ids, counts = self._merge(raw, starts, sizes)
            return ids, counts
        memory, some, wide = self.memory, hashes[first], sizes[first]
        if memory.n + len(first) > REMEMBERED:
            memory.clear()
        entry = memory.find(some)
        known = np.flatnonzero(entry >= 0)
        there = memory.raw_at[entry[known] + 1] - memory.raw_at[entry[known]] == wide[known]
        known = known[there]
        unlike = memory.raw[spread(memory.raw_at[entry[known]], wide[known])] != raw[spread(starts[first[known]], wide[known])]
        fine = np.ones(len(known), bool)
        if unlike.any():
            fine[np.repeat(np.arange(len(known)), wide[known])[unlike]] = False
        is_known = np.zeros(len(first), bool)
        is_known[known[fine]] = True
        fresh = np.flatnonzero(~is_known)
        begins, counts = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        got = known[fine]
        begins[got], counts[got] = memory.id_at[entry[got]], memory.id_at[entry[got] + 1] - memory.id_at[entry[got]]
        made, many = self._merge(raw, starts[first[fresh]], wide[fresh])
        base = len(memory.ids)
        counts[fresh], begins[fresh] = many, base + np.cumsum(many) - many
        table = np.concatenate([memory.ids, made])
        out = table[spread(begins[group], counts[group])]
        keep = (entry[fresh] < 0) & (wide[fresh] <= LONGEST)
        if memory.n + keep.sum() <= REMEMBERED:
            kept = fresh[keep]
            memory.add(some[kept], raw[spread(starts[first[kept]], wide[kept])], wide[kept], table[spread(begins[kept], counts[kept])], counts[kept])
        return out, counts[group]

    def _merge(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        long = np.flatnonzero(sizes > LONGEST)
        if not len(long):
            return self.merger.encode(raw, starts, sizes, self.kind)
        short = np.flatnonzero(sizes <= LONGEST)
        ids, some = self.merger.encode(raw, starts[short], sizes[short], self.kind)
        others = [self._piece(raw[starts[i] : starts[i] + sizes[i]].tobytes()) for i in long]
        counts = np.zeros(len(sizes), np.int64)
        counts[short], counts[long] = some, [len(x) for x in others]
        begins = np.zeros(len(sizes), np.int64)
        begins[short], begins[long] = np.cumsum(some) - some, len(ids) + np.cumsum(counts[long]) - counts[long]
        return np.concatenate([ids, *others])[spread(begins, counts)], counts

    def encode_buffer(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the whole texts raw[at[i]:at[i + 1]] end to end, and how many each has."""
        ids, counts = [], []
        for first, last in shared.row_blocks(at, BLOCK):
            part = raw[at[first] : at[last]]
            if last - first == 1 and len(part) > PARTED and self.merger:
                found = [self._block(x, np.array([0, len(x)]))[0] for x in self._parted(part)]
                ids += found
                counts.append(np.array([sum(map(len, found))], np.int64))
            else:
                found, n = self._block(part, at[first : last + 1] - at[first])
                ids.append(found)
                counts.append(n)
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, self.kind), np.zeros(0, np.int64))

    def _parted(self, raw: np.ndarray):
        """Pieces of a long text, of about BLOCK bytes where it has a space between letters; their ids in a row are the text's."""
        text, begin = raw.tobytes(), 0
        while begin < len(text):
            found = None if any(x in text for x in self.special) else BETWEEN.search(text, begin + BLOCK)
            end = found.start() if found else len(text)
            yield raw[begin:end]
            begin = end

    def ended(self, raw: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts with `end_id` after each, in a kind that holds it, and the places where texts begin, with the end of all."""
        ids, n = self.encode_buffer(raw, at)
        kind = self.kind if end_id < 1 << 8 * self.kind.itemsize else np.dtype(np.uint32)
        return np.insert(ids.astype(kind, copy=False), np.cumsum(n), end_id), np.concatenate([[0], np.cumsum(n + 1)])

    def encode(self, text: bytes) -> bytes:
        """The ids of one whole text, as bytes of `kind`."""
        return self.encode_buffer(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0].tobytes()
