"""SentencePiece unigram encoding and decoding.

The most probable segmentation (Viterbi over piece scores) with pieces found through a double-array trie over
UTF-8 bytes, byte fallback for characters that no piece covers, and whitespace markers. The model file is read by
the driver alone and goes to the executors as arrays of a fixed size, the vocabulary's. A segment ends where no
piece can cross: before a run of spaces and at line feeds when no piece holds one. Segments repeat, so each
worker keeps a bounded table of those it has met; new ones are segmented together, array-wise.

A marker character that stands in a text itself is encoded as bytes, so that decoding returns every text exactly; where
a model's normaliser changes texts (its character map, squeezed spaces), it returns the normalised text. Pieces that the
model's user defined are cut out first.

A byte-pair model has ranks in place of scores: its n-th piece has the score -n. They become log scores by Zipf's
law, the probability of the n-th piece being in proportion to 1 / (n + 1).

Defined cases: a null text has null ids and no tokens; an empty text has none; ids of an unknown piece don't arise, as
bytes cover everything; repeated rows are encoded alike; an empty table gives an empty result; other columns
pass through `encode`, whose own columns are `ids` and `n_tokens`, with underscores where a column has that name.
"""

from __future__ import annotations

import math
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_arrow, runs_of, text_bytes

MARK = "▁"
#: A character that only byte pieces cover scores this much less than the worst piece, as published.
UNKNOWN_PENALTY = 10.0
#: Segments that a worker remembers, and the longest it remembers, in characters.
CACHE, CACHED_CHARS = 100_000, 64
#: Characters of text looked at before new segments are encoded, and of those that are encoded together.
RUN_CHARS, SEGMENT_CHARS = 1 << 19, 1 << 16
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BYTE_PAIR = 2


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message's fields."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            at += n
            yield key >> 3, data[at - n : at]
        else:
            n = 8 if kind == 1 else 4
            at += n
            yield key >> 3, data[at - n : at]


def read_model(path: str) -> tuple[list[tuple[str, float, int]], dict]:
    """(piece, log score, type) of each id, and the settings that matter here."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, settings = [], {"prefix": True, "squeeze": True, "charsmap": b"", "kind": 1}
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        elif number == 2:
            settings["kind"] = dict(_fields(value)).get(3, 1)
        elif number == 3:
            own = dict(_fields(value))
            settings |= {"prefix": bool(own.get(3, 1)), "squeeze": bool(own.get(4, 1)), "charsmap": own.get(2, b"")}
    if settings["kind"] == BYTE_PAIR:
        ranks = {i: -score for i, (_, score, kind) in enumerate(pieces) if kind == NORMAL}
        total = math.log(sum(1 / (r + 1) for r in ranks.values()))
        # Multiples of 2**-20 add up without rounding, so equal segmentations tie wherever a text is cut.
        pieces = [(piece, round((-math.log(ranks[i] + 1) - total) * 2**20) / 2**20 if i in ranks else score, kind) for i, (piece, score, kind) in enumerate(pieces)]
    return pieces, settings


def character_map(blob: bytes) -> dict[str, str]:
    """What a normaliser's compiled map turns strings into: a public double-array format, then texts that end in NUL."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units, texts = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), blob[4 + size :]
    offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
    letters, out, todo = np.arange(1, 256), {}, [(0, b"")]
    while todo:
        node, key = todo.pop()
        base = node ^ offset(int(units[node]))
        if key and units[node] >> 8 & 1:
            at = int(units[base]) & 0x7FFFFFFF
            out[key.decode()] = texts[at : texts.index(b"\0", at)].decode()
        places = base ^ letters
        places = places[places < len(units)]
        for p in places[(units[places] & (1 << 31 | 0xFF)) == places ^ base].tolist():
            todo.append((p, key + bytes([p ^ base])))
    return out


class Normaliser:
    """A model's changes to a text before it is segmented; the longest string of the map that fits goes first."""

    def __init__(self, mapped: dict[str, str], squeeze: bool):
        self.single, self.squeeze = {ord(k): v for k, v in mapped.items() if len(k) == 1}, squeeze
        self.several = {k: v for k, v in mapped.items() if len(k) > 1}
        self.longest = max(map(len, self.several), default=0)
        later = {c for k in self.several for c in k[1:]}
        self.later = re.compile("[" + "".join(map(re.escape, sorted(later))) + "]") if later else None

    def __call__(self, text: str) -> str:
        if self.later is None or not self.later.search(text):
            text = text.translate(self.single)
        else:
            out, at = [], 0
            while at < len(text):
                n = next((n for n in range(min(self.longest, len(text) - at), 1, -1) if text[at : at + n] in self.several), 1)
                out.append(self.several[text[at : at + n]] if n > 1 else self.single.get(ord(text[at]), text[at]))
                at += n
            text = "".join(out)
        return re.sub(" +", " ", text).strip(" ") if self.squeeze else text


def build_trie(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A double array (base, check, value) over the keys; value is a key's place or -1, and 0 is the root."""
    order = sorted(range(len(keys)), key=lambda i: keys[i])
    size = 1 << 16
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0] = 0
    todo, hint = [(0, 0, len(order), 0)], {}
    for node, lo, hi, depth in todo:
        while lo < hi and len(keys[order[lo]]) == depth:
            value[node] = order[lo]
            lo += 1
        groups = []
        while lo < hi:
            c, end = keys[order[lo]][depth], lo + 1
            while end < hi and keys[order[end]][depth] == c:
                end += 1
            groups.append((c, lo, end))
            lo = end
        if not groups:
            continue
        # Nodes of as many children search on from where the last such search ended, as denser room was used up.
        width = min(len(groups), 32)
        b = hint.get(width, 1)
        while True:
            if b + 256 >= len(base):
                more = len(base)
                base += [0] * more
                check += [-1] * more
                value += [-1] * more
            if all(check[b + c] == -1 for c, _, _ in groups):
                break
            b += 1
        hint[width] = b
        base[node] = b
        for c, x, y in groups:
            check[b + c] = node
            todo.append((b + c, x, y, depth + 1))
    n = max(i for i, c in enumerate(check) if c != -1) + 257
    return np.array(base[:n], np.int32), np.array((check + [-1] * 257)[:n], np.int32), np.array((value + [-1] * 257)[:n], np.int32)


class Vocabulary:
    """A model's pieces with their trie; holds arrays only, of a size that the model file fixes."""

    def __init__(self, path: str):
        pieces, settings = read_model(path)
        self.prefix = settings["prefix"]
        changes = settings["charsmap"] or settings["squeeze"]
        self.normalise = Normaliser(character_map(settings["charsmap"]), settings["squeeze"]) if changes else None
        self.defined: dict[str, int] = {}
        self.byte_ids = np.full(256, -1, np.int32)
        blobs, keys, ids, scores = [], [], [], []
        for i, (piece, score, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_ids[int(piece[1:-1], 16)] = i
                blobs.append(bytes([int(piece[1:-1], 16)]))
                continue
            blobs.append(piece.replace(MARK, " ").encode() if kind in (NORMAL, USER_DEFINED) else b"")
            if kind == USER_DEFINED:
                self.defined[piece.replace(MARK, " ")] = i
            if kind == NORMAL:
                keys.append(piece.replace(MARK, " ").encode())
                ids.append(i)
                scores.append(score)
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte fallback")
        if any(re.search("[^ ] ", k.decode()) for k in keys):
            raise ValueError("pieces that go on after a space are not supported")
        whole = any(b"\n" in k for k in keys)
        own = "|".join(map(re.escape, sorted(self.defined, key=len, reverse=True)))
        letter = ("[^ ]" if whole else "[^ \n]") if not own else f"(?:(?!{own}){'[^ ]' if whole else '[^ \n]'})"
        self.split = re.compile(own + "|" * bool(own) + f" *{letter}+|" + "\n|" * (not whole) + " +")
        self.base, self.check, place = build_trie(keys)
        self.ids, self.scores = np.array([*ids, 0], np.int32), np.array([*scores, 0.0])
        self.value = place
        self.longest = max(map(len, keys))
        self.unknown = float(min(scores)) - UNKNOWN_PENALTY
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        self.blob_len = np.array([len(b) for b in blobs], np.int64)
        self.blob_at = np.concatenate(([0], np.cumsum(self.blob_len)[:-1]))

    def segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of the best segmentation of each chunk, one after the other."""
        raw = [c.encode("utf-8", "surrogatepass") for c in chunks]
        lens = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw) + b"\0", np.uint8).astype(np.int32)
        ends = np.cumsum(lens)
        at0 = ends - lens
        row = np.repeat(np.arange(len(raw)), lens)
        n = int(ends[-1]) if len(raw) else 0
        lead = (data[:n] & 0xC0) != 0x80
        starts = np.flatnonzero(lead)
        char_end = np.append(starts[1:], n)
        # All matches, from all starts at once, one byte deeper at a time.
        state, where = np.zeros(len(starts), np.int32), starts.copy()
        begin, limit = starts, ends[row[starts]]
        found_a, found_b, found_p = [], [], []
        for _ in range(self.longest):
            live = where < limit
            begin, where, limit, state = begin[live], where[live], limit[live], state[live]
            step = self.base[state] + data[where]
            live = self.check[step] == state
            live &= step != 0
            begin, where, limit, state = begin[live], where[live] + 1, limit[live], step[live]
            if not len(begin):
                break
            hit = self.value[state] >= 0
            found_a.append(begin[hit])
            found_b.append(where[hit])
            found_p.append(self.value[state[hit]])
        a = np.concatenate([*found_a, np.zeros(0, np.int64)]).astype(np.int64)
        b = np.concatenate([*found_b, np.zeros(0, np.int64)]).astype(np.int64)
        p = np.concatenate([*found_p, np.zeros(0, np.int64)]).astype(np.int64)
        # Characters without a piece of their own go to bytes.
        alone = np.zeros(n + 1, bool)
        end_of = np.zeros(n + 1, np.int64)
        end_of[starts] = char_end
        alone[a[b == end_of[a]]] = True
        bare = starts[~alone[starts]]
        a, b = np.concatenate((a, bare)), np.concatenate((b, end_of[bare]))
        gain = np.concatenate((self.scores[p], np.full(len(bare), self.unknown)))
        p = np.concatenate((p, np.full(len(bare), -1, np.int64)))
        # Best score by end, nearest to the chunk's start first; equal scores go to the earlier start.
        own = row[a]
        depth = b - at0[own]
        order = np.lexsort((a, b, depth))
        a, b, p, gain, depth = a[order], b[order], p[order], gain[order], depth[order]
        # best and back are kept by the byte at which a match ends, counted so that chunks don't meet.
        slot = np.arange(n) + row + 1  # a chunk of length L has L + 1 slots
        best, back = np.full(n + len(raw) + 1, -np.inf), np.zeros(n + len(raw) + 1, np.int64)
        best[at0 + np.arange(len(raw))] = 0.0
        from_, to = slot[a] - 1, slot[b - 1]
        cuts = np.concatenate((np.flatnonzero(np.concatenate(([True], depth[1:] != depth[:-1]))), [len(depth)])) if len(depth) else np.zeros(1, np.int64)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            total, ends_at = best[from_[lo:hi]] + gain[lo:hi], to[lo:hi]
            first = np.flatnonzero(np.concatenate(([True], ends_at[1:] != ends_at[:-1])))
            top = np.maximum.reduceat(total, first)
            size = np.diff(np.append(first, hi - lo))
            is_top = np.flatnonzero(total == np.repeat(top, size))
            which = is_top[np.searchsorted(is_top, first)]
            best[ends_at[first]], back[ends_at[first]] = top, lo + which
        # Back from every chunk's end at once.
        here = np.flatnonzero(lens)
        cursor, chosen_row, chosen = ends[here] + here, [], []
        while len(here):
            m = back[cursor]
            chosen_row.append(here)
            chosen.append(m)
            cursor = from_[m]
            live = cursor > at0[here] + here
            here, cursor = here[live], cursor[live]
        if not chosen:
            return np.zeros(0, np.int32), np.zeros(len(raw), np.int64)
        chosen, chosen_row = np.concatenate(chosen), np.concatenate(chosen_row)
        order = np.lexsort((a[chosen], chosen_row))
        chosen, chosen_row = chosen[order], chosen_row[order]
        piece = p[chosen]
        width = np.where(piece < 0, b[chosen] - a[chosen], 1)
        out = np.repeat(self.ids[piece], width)
        byte = np.repeat(piece < 0, width)
        inner = np.arange(len(out)) - np.repeat(np.cumsum(width) - width, width)
        out[byte] = self.byte_ids[data[(np.repeat(a[chosen], width) + inner)[byte]]]
        return out, np.bincount(chosen_row, weights=width, minlength=len(raw)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts of these ids, of which each text has so many."""
        size = self.blob_len[ids]
        before = np.cumsum(size) - size
        data = self.blob[np.repeat(self.blob_at[ids] - before, size) + np.arange(int(size.sum()))]
        ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))]
        if self.prefix:  # each text's first byte is the space that encoding put there
            keep = np.ones(len(data), bool)
            keep[ends[:-1][counts > 0]] = False
            data = data[keep]
            ends = ends - np.concatenate(([0], np.cumsum(counts > 0)))
        return data, ends


_CACHES: dict[int, tuple[dict, list]] = {}


class Encoder:
    """Encodes lists of texts with a worker's own memory of segments."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._forget()

    def _forget(self) -> None:
        """Knows only the pieces that the user defined."""
        self.known = {piece: k for k, piece in enumerate(self.v.defined)}
        self.flat, self.count = [np.array(list(self.v.defined.values()), np.int32)], [np.ones(len(self.v.defined), np.int64)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text)."""
        ids, sizes = [], []
        lo = 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= RUN_CHARS):
                chars += len(texts[hi])
                hi += 1
            x, n = self._run(texts[lo:hi])
            ids.append(x)
            sizes.append(n)
            lo = hi
        return np.concatenate([*ids, np.zeros(0, np.int32)]), np.concatenate([*sizes, np.zeros(0, np.int64)]).astype(np.int64)

    def _segments(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """segment() in parts, as its working arrays are many times the size of what it is given."""
        ids, counts, lo = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while lo < len(new):
            hi, chars = lo, 0
            while hi < len(new) and (hi == lo or chars + len(new[hi]) <= SEGMENT_CHARS):
                chars += len(new[hi])
                hi += 1
            x, n = self.v.segment(new[lo:hi])
            ids.append(x)
            counts.append(n)
            lo = hi
        return np.concatenate(ids), np.concatenate(counts)

    def _run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split, lead = self.v.split.findall, " " if self.v.prefix else ""
        if len(self.known) > CACHE:
            self._forget()
        known, number = self.known, []
        chunks = [split(lead + t) if t else [] for t in texts]
        new: dict[str, int] = {}
        first = len(known)
        for c in chunks:
            number.append(np.fromiter((k if (k := known.get(x)) is not None else new.setdefault(x, first + len(new)) for x in c), np.int64, len(c)))
        ids, counts = self._segments(list(new))
        flat = np.concatenate([*self.flat, ids])
        count = np.concatenate([*self.count, counts]).astype(np.int64)
        at = np.cumsum(count) - count
        every = np.concatenate([*number, np.zeros(0, np.int64)]).astype(np.int64)
        size = count[every]
        before = np.cumsum(size) - size
        out = flat[np.repeat(at[every] - before, size) + np.arange(int(size.sum()))]
        per_text = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum([len(c) for c in chunks])))]
        if first + len(new) <= CACHE and (not new or max(map(len, new)) <= CACHED_CHARS):
            known.update(new)
            self.flat, self.count = [flat], [count]
        elif first + len(new) <= CACHE:
            keep = [(x, k - first) for x, k in new.items() if len(x) <= CACHED_CHARS]
            if keep:
                own = np.array([k for _, k in keep])
                begin = (np.cumsum(counts) - counts)[own]
                n = counts[own]
                ids = ids[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                known.update({x: first + i for i, (x, _) in enumerate(keep)})
                self.flat, self.count = [*self.flat, ids], [*self.count, n]
        else:
            self._forget()
        return out, np.diff(per_text)


def _own_names(keep: list[str], verify: bool) -> list[str]:
    return [free_name(n, keep) for n in ("ids", "n_tokens", "round_trip")[: 2 + verify]]


def _encoder(vocabulary, text_at: int, names: list[str], verify: bool):
    more = _own_names(names, verify)

    def encode(batches):
        encoder = _CACHES.get("encoder")
        if encoder is None:
            encoder = _CACHES["encoder"] = Encoder(vocabulary.value)
        for batch in batches:
            column = batch.column(text_at)
            for lo, hi in runs_of(text_bytes(column)[1], RUN_CHARS):  # ids take more room than texts, so batches are cut
                part = column.slice(lo, hi - lo)
                texts = [t or "" for t in part.to_pylist()]
                if encoder.v.normalise:
                    texts = [encoder.v.normalise(t) for t in texts]
                ids, counts = encoder.encode(texts)
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                null = part.is_null() if part.null_count else None
                arrays = [batch.column(k).slice(lo, hi - lo) for k in range(len(names))]
                arrays += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()), mask=null), pa.array(counts)]
                if verify:
                    data, ends = encoder.v.decode(ids, counts)
                    data = data.tobytes()
                    same = [data[a:b] == t.encode() for a, b, t in zip(ends[:-1].tolist(), ends[1:].tolist(), texts)]
                    arrays.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays(arrays, [*names, *more])

    return encode


def encode(docs: DataFrame, model_path: str, keep: list[str], text_col: str = "text", verify: bool = False) -> DataFrame:
    """The columns `keep`, ids (array of int), n_tokens, and with `verify` whether decoding gave the text back.

    A column of `keep` with such a name keeps it, and the result's gets underscores."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model_path))
    read = docs.select(*keep, *[text_col] * (text_col not in keep))
    kinds = ", ".join(f"`{c}` {read.schema[c].dataType.simpleString()}" for c in keep)
    return map_arrow(read, _encoder(shared, read.columns.index(text_col), keep, verify), ", ".join([kinds, *(f"`{n}` {k}" for n, k in zip(_own_names(keep, verify), ("array<int>", "long", "boolean")))]))


def decode(encoded: DataFrame, model_path: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """The columns `keep` and `text`, decoded from the ids; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model_path))
    read = encoded.select(*keep, F.col(ids_col).alias("_ids"))

    def run(batches):
        for batch in batches:
            lists = batch.column(len(keep))
            rows = [np.zeros(0, np.int32) if x is None else np.array(x, np.int32) for x in lists.to_pylist()]
            counts = np.array([len(r) for r in rows], np.int64)
            data, ends = shared.value.decode(np.concatenate([*rows, np.zeros(0, np.int32)]), counts)
            data = data.tobytes()
            texts = [None if null else data[a:b].decode() for a, b, null in zip(ends[:-1].tolist(), ends[1:].tolist(), lists.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(texts, pa.string())], [*keep, "text"])

    kinds = ", ".join(f"`{c}` {read.schema[c].dataType.simpleString()}" for c in keep)
    return map_arrow(read, run, f"{kinds}, text string")
