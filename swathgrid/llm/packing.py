"""Cost-balanced packing of tokenised documents into sequences of bounded length.

A piece of n tokens costs n + n*n / quad: a linear part and attention's quadratic part. Documents longer than a sequence
are first cut into whole sequences. The rest goes, longest first, to the sequence of lowest cost that has room
for it. What fits nowhere whole is cut over the gaps that are left. There are exactly as many
sequences as the tokens fill, so only the end of a partition can be short; it is written as
sequences whose lengths are powers of two, which need no padding.

Tasks pack their own partition in windows of a fixed number of tokens; nothing is shuffled.
"""

from __future__ import annotations

import itertools
import os
import re
import sys
import zlib
from collections.abc import Iterable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from swathgrid.llm.common import id_and_text, joined, slices

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, ids binary"
)


#: Words of Latin letters, digits and signs without contractions; control tokens are looked for besides. No two of these
#: characters compose, and each has one in lower case.
PLAIN = "^[!-&(-~À-ÖØ-öø-ÿ¡«»¿‐-‧]*$"
#: What the vocabulary's own patterns cut off from runs of letters in a plain word in lower case.
CUT_OFF = "([^0-9a-zß-öø-ÿ]+|[0-9])"
#: Bytes of text whose words are looked up at once.
LOOKUP_BYTES = 4 << 20


class WordIds:
    """Token ids of texts, word by word.

    The vocabulary splits at white space before anything else, so a text's ids are those of its
    words in order, and a plain word's those of its runs of letters, digits and signs. The ids of runs and of
    other words are kept as bytes; a full store is emptied. Arrow splits the texts, finds the distinct words and
    cuts them, so Python sees a run once for all texts that are encoded together.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Runs are in the normal form and cut already.
        self.runs = Tokenizer.from_file(path)
        self.runs.normalizer = normalizers.Sequence([])
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.runs.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), as_bytes])
        self.most, self.known, self.plain = most, {"": b""}, re.compile(PLAIN).match
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a run
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _learn(self, new: list[str]) -> None:
        runs = [w for w in new if self.plain(w) and "<|" not in w]
        if len(runs) < len(new):
            other = list(set(new).difference(runs))
            for w, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, "<u4").tobytes()
        # Many runs make one text, as each gives exactly one id that ends a run.
        for at in range(0, len(runs), 4096):
            some = runs[at : at + 4096]
            (encoded,) = self.runs.encode_batch_fast([" ".join(some)], add_special_tokens=False)
            ids = np.array(encoded.ids, "<u4")
            raw, begin = ids.tobytes(), 0
            for w, end in zip(some, (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), strict=True):
                self.known[w] = raw[begin:end]
                begin = end

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, and where each word's begin and end."""
        plain = pc.and_not(pc.match_substring_regex(words, PLAIN), pc.match_substring(words, "<|"))
        apart = pc.replace_substring_regex(pc.utf8_lower(words), CUT_OFF, r" \1 ")
        cut = pc.ascii_split_whitespace(pc.if_else(plain, apart, words))
        runs = cut.flatten().dictionary_encode()
        distinct = runs.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in distinct if w not in self.known]
        if new:
            self._learn(new)
        held = [self.known[w] for w in distinct]
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        ids, ends = joined(np.frombuffer(b"".join(held), "<u4"), sizes, runs.indices.to_numpy())
        return ids, ends[cut.offsets.to_numpy()]

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        if len(self.known) > self.most:
            self.known = {"": b""}
        # White space beyond ASCII stays in words, which the tokenizer then cuts itself.
        split = pc.ascii_split_whitespace(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        words = split.flatten().dictionary_encode()
        ids, ends = self._words(words.dictionary)
        ids, ends = joined(ids, np.diff(ends), words.indices.to_numpy())
        return [ids[a:b] for a, b in itertools.pairwise(ends[split.offsets.to_numpy()].tolist())]


def _kept(path: str) -> WordIds:
    """One store of words for all tasks of a Python worker, as of `pieces`."""
    store = sys.modules.setdefault("swathgrid_packing_store", ModuleType("swathgrid_packing_store"))
    if getattr(store, "path", None) != path:
        store.path, store.words = path, WordIds(path)
    return store.words


Piece = tuple[int, int, int]  # document's place in the window, first token, tokens


def pack_window(sizes: list[int], capacity: int, quad: float) -> list[list[Piece]]:
    """Sequences of pieces that hold all tokens; all are full but the last."""
    full, rest = [], []
    for d, n in enumerate(sizes):
        cut = n - n % capacity
        full += [[(d, s, capacity)] for s in range(0, cut, capacity)]
        if n > cut:
            rest.append((n - cut, d, cut))
    total = sum(n for n, _, _ in rest)
    if not total:
        return full
    count = -(-total // capacity)
    room = np.full(count, capacity, np.int64)
    room[-1] = total - (count - 1) * capacity
    cost = np.zeros(count)
    cost[-1] = (capacity - room[-1]) * (1 + capacity / quad)  # the short one counts as partly used
    made: list[list[Piece]] = [[] for _ in range(count)]
    loose = []
    for n, d, s in sorted(rest, key=lambda x: (-x[0], x[1])):
        open_cost = np.where(room >= n, cost, np.inf)
        k = int(open_cost.argmin())
        if open_cost[k] == np.inf:
            loose.append((n, d, s))
            continue
        made[k].append((d, s, n))
        room[k] -= n
        cost[k] += n + n * n / quad
    gaps = iter(np.flatnonzero(room))
    k = next(gaps, None)
    for n, d, s in loose:
        while n:
            if not room[k]:
                k = next(gaps)
            take = min(n, int(room[k]))
            made[k].append((d, s, take))
            room[k] -= take
            n, s = n - take, s + take
    return full + [m for m in made[:-1]] + [made[-1]]


def powers_of_two(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """Cut a short sequence into sequences whose lengths are powers of two."""
    left, out, queue = sum(n for _, _, n in pieces), [], list(pieces)
    while left:
        size = min(1 << (left.bit_length() - 1), capacity)
        part, need = [], size
        while need:
            d, s, n = queue.pop(0)
            take = min(n, need)
            part.append((d, s, take))
            need -= take
            if take < n:
                queue.insert(0, (d, s + take, n - take))
        out.append(part)
        left -= size
    return out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int = 2,
    quad: float = 4096.0,
    window_tokens: int = 2_000_000,
    key: str = "doc_id",
    text: str = "text",
    keep_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Every document ends with `end_id`, so null and empty texts are one token. Sequences are full
    or a power of two long. Each row of the input is packed by itself, repeated ones too; ids may be
    null, other columns are not read, an empty table gives no rows. A sequence's id is made of
    the partition's number and its place there, and so is the same when a task is run again.
    `ids` holds the piece's ids as little-endian unsigned 32-bit numbers, or null without keep_ids.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _kept(tokenizer_path)
        base, made = TaskContext.get().partitionId() << 36, 0
        window: list[tuple[int | None, np.ndarray, int, int]] = []  # id, ids, start, all tokens of the document
        held = 0

        def out(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal made
            rows = []
            for pieces in sequences:
                offset = 0
                for d, s, n in pieces:
                    doc_id, ids, first, total = window[d]
                    part = ids[s : s + n].astype("<u4").tobytes()
                    rows.append((doc_id, first + s, n, zlib.crc32(part), total, base + made, offset, part if keep_ids else None))
                    offset += n
                made += 1
            columns = list(zip(*rows, strict=True)) or [()] * 8
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(columns[7], pa.binary())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

        def flush(last: bool):
            nonlocal window, held
            sequences = pack_window([len(w[1]) for w in window], capacity, quad)
            short = [sequences.pop()] if sequences and sum(p[2] for p in sequences[-1]) < capacity else []
            if last and short:
                sequences += powers_of_two(short[0], capacity)
            yield out(sequences)
            # A short sequence goes into the next window.
            window = [(window[d][0], window[d][1][s : s + n], window[d][2] + s, window[d][3]) for p in short for d, s, n in p]
            held = sum(len(w[1]) for w in window)

        for some in slices(batches, "text", LOOKUP_BYTES):
            for doc_id, tokens in zip(some.column(0).to_pylist(), words.encode(some.column(1)), strict=True):
                tokens = np.append(tokens, np.uint32(end_id))
                window.append((doc_id, tokens, 0, len(tokens)))
                held += len(tokens)
                if held >= window_tokens:
                    yield from flush(False)
        if window:
            yield from flush(True)

    return id_and_text(docs, key, text).mapInArrow(run, SCHEMA)
