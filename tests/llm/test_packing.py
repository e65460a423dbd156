import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from helpers import docs_of, documents, edge_docs, empty_docs

from swathgrid.llm import packing
from swathgrid.llm.packing import WordIds, pack, pack_window
from hypothesis import given, settings
from hypothesis import strategies as st

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def check(rows, docs, capacity):
    """docs: list of (id, text); ids may repeat with equal texts only."""
    ids = dict(zip([d for d, _ in docs], whole([t for _, t in docs]), strict=True))
    by_seq, taken = defaultdict(list), defaultdict(int)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        by_seq[r.sequence_id].append((r.offset, r.length))
        taken[r.doc_id] += r.length
    assert sum(taken.values()) == sum(len(ids[d]) for d, _ in docs)
    for parts in by_seq.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= capacity and (end == capacity or end & (end - 1) == 0)


def test_table_packs_whole(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check(pack(docs, PATH).collect(), rows, 4096)
    check(pack(docs, PATH, capacity=512, window_tokens=5000).collect(), rows, 512)


def test_edges(spark):
    docs = edge_docs(spark)
    check(pack(docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()], 4096)
    assert pack(empty_docs(spark), PATH).count() == 0
    kept = pack(docs_of(spark, ["one two"]), PATH).collect()
    assert b"".join(r["ids"] for r in kept) == np.array(whole(["one two"])[0], "<u4").tobytes()


def test_tasks_of_a_worker_share_their_words(spark):
    store = packing._kept(PATH)
    store.encode(["one two"])
    assert packing._kept(PATH) is store and "two" in store.known
    docs = docs_of(spark, ["one two", "three", None, "two"] * 50).repartition(24)
    order = ["sequence_id", "offset"]
    assert pack(docs, PATH).orderBy(*order).collect() == pack(docs, PATH).orderBy(*order).collect()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_word_ids_equal_those_of_whole_texts(text):
    assert WORDS.encode([text])[0].tolist() == whole([text])[0][:-1]


WORDS = WordIds(PATH, most=50)


def test_words_share_their_runs():
    words = WordIds(PATH)
    texts = ["Über den Fluß, den fluß. ÉTÉ été42", "über; (den) <|endoftext|> 中文 l'été fluß\x1c den", "", " \t", "e\u0301t\xa0A\u0300"]
    assert [x.tolist() for x in words.encode(texts)] == [x[:-1] for x in whole(texts)]
    assert {"über", "fluß", "été", ",", "4"} < set(words.known) and not {"Über", "fluß,", "été42"} & set(words.known)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=60))
def test_window_is_full_but_for_its_end(sizes):
    out = pack_window(sizes, 64, 64.0)
    assert all(sum(n for *_, n in p) == 64 for p in out[:-1])
    cover = defaultdict(list)
    for p in out:
        for d, s, n in p:
            cover[d].append((s, n))
    for d, n in enumerate(sizes):
        at = 0
        for s, k in sorted(cover[d]):
            assert s == at
            at += k
        assert at == n


def test_costs_are_balanced():
    rng = np.random.default_rng(1)
    sizes = rng.integers(10, 1500, 2000).tolist()
    out = pack_window(sizes, 4096, 4096.0)
    costs = [sum(n + n * n / 4096 for *_, n in p) for p in out[:-1]]
    naive = sorted(sizes)
    assert np.std(costs) < 0.12 * np.mean(costs) and len(naive) == 2000
