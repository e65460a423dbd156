"""SentencePiece encoding and decoding as a weighted transducer, for BPE models with byte fallback.

The model file is compiled into three transducers: the normaliser (a prefix mark, blanks to marks), the piece
lexicon with byte fallback, and an acceptor of piece pairs. Composed with an input they give a
lattice whose states are (position, last piece). Summed piece weights cannot express the order of BPE
merges, so the weights sit on pairs: an arc costs 0 if the pair of pieces is what merging gives for
their joined text, and infinity otherwise. Merging has one result for every prefix of
the input, so each position has at most one state at cost 0. The tropical shortest path is found depth first, longest
arcs first, and a position from which the end was not reached is not entered again.

The acceptor is compiled from the order of merges: each piece is split into the two parts of its last merge. Where pieces u and v
meet, the parts at the boundary are the right-hand parts of u and the left-hand parts of v, each for the
time from the merge that makes it to the one that takes it up. Going back in time, u and v stay apart if no two
parts that touch make a piece that merges earlier than either of them is taken up, the leftmost first among equals.

No piece has a mark after another character, so an input falls into independent segments (marks, then other
characters). If the model has no piece with a letter next to anything but letters and a mark before them, segments
end there too. Segments that begin with two marks or more have pieces of equal weight, where
the order of merges decides; these runs are merged directly.
"""

from __future__ import annotations

import heapq
import itertools
import re
import struct
import sys
import zlib
from collections.abc import Iterable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from swathgrid.llm.common import id_and_text, joined, slices

MARK = "▁"
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Bytes of text whose segments are looked up at once.
LOOKUP_BYTES = 4 << 20
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            c = data[at]
            at += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces, bytes and normaliser of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.rank: dict[str, tuple[float, int]] = {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                text, kind = piece[1].decode(), piece.get(3, NORMAL)
                if kind == NORMAL:
                    self.rank[text] = (struct.unpack("<f", piece[2])[0], len(self.pieces))
                self.pieces.append(text)
                self.kinds.append(kind)
            elif field == 3:
                norm = dict(_fields(value))
                if norm.get(2):
                    raise ValueError("only models with the identity normaliser are supported")
                self.prefix, self.squeeze = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        if self.squeeze:
            raise ValueError("models that remove extra blanks are not supported")
        self.bytes = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.longest = max(map(len, self.rank))
        # Segments: marks, then letters or then other characters, provided that no piece crosses from one to the other.
        letters = re.escape("".join(sorted({c for p in self.rank if len(p) > 1 for c in p if c.isalpha()})))
        crossing = re.compile(f"[{letters}][^{letters}]|[^{letters}{MARK}][{letters}]") if letters else None
        apart = crossing is not None and not any(map(crossing.search, self.rank))
        self.segment = f"{MARK}*[{letters}]+|{MARK}*[^{letters}{MARK}]+|{MARK}+" if apart else SEGMENT.pattern
        # Bytes that an id stands for; pieces that are neither text nor bytes stand for none.
        self.spelled = [
            bytes([self.byte_of[i]]) if i in self.byte_of else p.encode() if kind == NORMAL else b""
            for i, (p, kind) in enumerate(zip(self.pieces, self.kinds, strict=True))
        ]

    def normalise(self, text: str) -> str:
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def merged(self, text: str) -> list[str]:
        """Merging as such: the best-scored adjacent pair first, the leftmost among equals."""
        return self.merge(text)[0]

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """What merging gives, and the two parts of the last merge."""
        last = None
        parts: list[str] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts) and (found := self.rank.get(parts[i] + parts[after[i]])):
                heapq.heappush(queue, (-found[0], i, parts[i] + parts[after[i]]))

        for i in range(len(parts)):
            offer(i)
        while queue:
            _, i, joined = heapq.heappop(queue)
            j = after[i]
            if not parts[i] or j >= len(parts) or parts[i] + parts[j] != joined:
                continue
            last = parts[i], parts[j]
            parts[i], parts[j] = joined, ""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p], last


class Transducer:
    """Encodes and decodes; what segments and pairs gave is kept until the store is full."""

    def __init__(self, path: str, most: int = 400_000):
        self.model, self.most = Model(path), most
        self.splits: dict[str, tuple[str, str] | None] = {}
        self.order: dict[str, float] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        lengths: dict[str, set[int]] = {}
        for piece in self.model.rank:
            lengths.setdefault(piece[:3], {1, 2}).add(len(piece))
        # Lengths that pieces have, the longest first, by their first three characters.
        self.reach = {begin: sorted(found, reverse=True) for begin, found in lengths.items()}
        self.known: dict[str, bytes] = {}

    def _compile(self, piece: str) -> float:
        """When merging makes the piece: the later, the larger. Single characters are there from the start; -2: never made."""
        if len(piece) == 1:
            when = -1.0
        else:
            parts, split = self.model.merge(piece)
            when = -self.model.rank[piece][0] if len(parts) == 1 else -2.0
            self.splits[piece] = split
        self.order[piece] = when
        return when

    def _when(self, piece: str) -> float:
        when = self.order.get(piece)
        return self._compile(piece) if when is None else when

    def _accepts(self, u: str, v: str) -> bool:
        """Whether merging leaves the boundary between pieces u and v."""
        rank, order, splits = self.model.rank, self.order, self.splits
        if u + v in rank and self._when(u + v) != -2.0:
            return False
        at_u = order[u] if u in order else self._compile(u)
        at_v = order[v] if v in order else self._compile(v)
        while at_u >= 0 or at_v >= 0:
            if at_u > at_v:  # among equals the left one merges first, so the right one is taken back first
                bound, u = at_u, splits[u][1]
                at_u = order[u] if u in order else self._compile(u)
                found = rank.get(u + v)
                if found is not None and -found[0] < bound:
                    return False
            else:
                bound, v = at_v, splits[v][0]
                at_v = order[v] if v in order else self._compile(v)
                found = rank.get(u + v)
                if found is not None and -found[0] <= bound:
                    return False
        return True

    def path(self, s: str) -> list[str]:
        """The shortest path through the lattice of a segment."""
        if s.startswith(MARK * 2):
            return self.model.merged(s)
        rank, order, pairs, reach, n = self.model.rank, self.order, self.pairs, self.reach, len(s)
        if len(pairs) > self.most:
            pairs.clear()
        out: list[str] = []
        dead: set[int] = set()
        at, before, most = 0, "", n
        while at < n:
            limit = min(most, n - at)
            for size in reach.get(s[at : at + 3], (2, 1)):
                if size > limit or at + size in dead:
                    continue
                piece = s[at : at + size]
                if size > 1 and (piece not in rank or (order[piece] if piece in order else self._compile(piece)) == -2.0):
                    continue
                if before:
                    good = pairs.get((before, piece))
                    if good is None:
                        good = pairs[before, piece] = self._accepts(before, piece)
                    if not good:
                        continue
                out.append(piece)
                at, before, most = at + size, piece, n
                break
            else:
                dead.add(at)
                most = len(out[-1]) - 1
                at -= len(out.pop())
                before = out[-1] if out else ""
        return out

    def _ids(self, s: str) -> list[int]:
        out = []
        for piece in self.path(s):
            found = self.model.rank.get(piece)
            out += [found[1]] if found else [self.model.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        return out

    def _words(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Normalised texts as words that begin with a mark: their places for each text, and the distinct words.

        The last of several blanks stands before a word, the others are marks already. Empty texts have no words.
        """
        if not self.model.prefix:
            split = pa.array([SEGMENT.findall(self.model.normalise(t)) for t in texts.to_pylist()], pa.list_(pa.string()))
            words = split.flatten().dictionary_encode()
            return pa.ListArray.from_arrays(split.offsets, words.indices), words.dictionary
        marked = pc.replace_substring_regex(texts, "^ ", MARK)
        marked = pc.replace_substring(pc.replace_substring(marked, "  ", " " + MARK), MARK + " ", MARK * 2)
        split = pc.split_pattern(pc.if_else(pc.equal(texts, ""), None, marked), " ")
        words = split.flatten().dictionary_encode()
        return pa.ListArray.from_arrays(split.offsets, words.indices), pc.binary_join_element_wise(MARK, words.dictionary, "")

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        if len(self.known) > self.most:
            self.known.clear()
        at, words = self._words(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        # No blanks are left, so they can part segments.
        apart = pc.ascii_rtrim(pc.replace_substring_regex(words, f"({self.model.segment})", r"\1 "), " ")
        cut = pc.split_pattern(apart, " ")
        segments = cut.flatten().dictionary_encode()
        distinct = segments.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.known
        for s in distinct:
            if s not in known:
                known[s] = np.array(self._ids(s), "<u4").tobytes()
        held = [known[s] for s in distinct]
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        ids, ends = joined(np.frombuffer(b"".join(held), "<u4"), sizes, segments.indices.to_numpy())
        ids, ends = joined(ids, np.diff(ends[cut.offsets.to_numpy()]), at.values.to_numpy())
        return [ids[a:b] for a, b in itertools.pairwise(ends[at.offsets.to_numpy()].tolist())]

    def decode(self, ids: Iterable[int]) -> str:
        """The text again; blanks and marks both come back as blanks."""
        model = self.model
        out = b"".join(map(model.spelled.__getitem__, ids))
        text = out.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if model.prefix and text.startswith(" ") else text


def _kept(path: str) -> Transducer:
    """One transducer for all tasks of a Python worker. Functions travel with the job, so their module's globals do not last."""
    store = sys.modules.setdefault("swathgrid_pieces_store", ModuleType("swathgrid_pieces_store"))
    if getattr(store, "path", None) != path:
        store.path, store.transducer = path, Transducer(path)
    return store.transducer


def encode_texts(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """One row per document: doc_id, n_ids, ids_crc32, n_byte_ids, round_trip, ids, decoded.

    ids are little-endian unsigned 32-bit numbers, decoded is the text made from them again; both are null
    without `keep`. round_trip tells whether decoding gives the text, in which U+2581 counts as the
    blank that it stands for. Whole texts are encoded; null is empty and has no ids. Repeated rows give repeated
    results, ids may be null, other columns are not read, an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _kept(model_path)
        low, high = min(fst.model.bytes), max(fst.model.bytes)
        for part in slices(batches, "text", LOOKUP_BYTES):
            rows = []
            for t, ids in zip(part.column(1).to_pylist(), fst.encode(part.column(1)), strict=True):
                data = ids.tobytes()
                back = fst.decode(ids.tolist())
                fallback = int(((ids >= low) & (ids <= high)).sum())
                rows.append((len(ids), zlib.crc32(data), fallback, back == t.replace(MARK, " "), data if keep else None, back if keep else None))
            columns = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.string()]
            names = ["doc_id", "n_ids", "ids_crc32", "n_byte_ids", "round_trip", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    schema = "doc_id long, n_ids long, ids_crc32 long, n_byte_ids long, round_trip boolean, ids binary, decoded string"
    return id_and_text(docs, key, text).mapInArrow(run, schema)
