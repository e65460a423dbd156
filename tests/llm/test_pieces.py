import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from helpers import documents, edge_docs, empty_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from swathgrid.llm.pieces import MARK, Transducer, encode_texts

PATH = public_tokenizers.path("piece_bpe_32k.model")
OURS, THEIRS = Transducer(PATH, most=2000), sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="theinganr  ▁<0x41>\n", max_size=60)))
def test_ids_and_text_equal_the_library(text):
    ids = OURS.encode([text])[0].tolist()
    assert ids == THEIRS.encode(text)
    assert OURS.decode(ids) == text.replace(MARK, " ")


def test_segments_end_where_no_piece_goes_on():
    fst = Transducer(PATH)
    texts = ["the fluß, the fluß.\nthe  fluß", "", "   the,  ", f"{MARK} the{MARK}{MARK} x ", "²., \x00the\x00 中文the"]
    assert [x.tolist() for x in fst.encode(texts)] == [THEIRS.encode(t) for t in texts]
    assert {f"{MARK}the", f"{MARK}fluß", f"{MARK * 2}fluß", ",", ".\n", "the"} < set(fst.known)
    assert not {f"{MARK}fluß,", f"{MARK}fluß.\nthe"} & set(fst.known)


def test_models_without_a_prefix_mark():
    fst = Transducer(PATH)
    fst.model.prefix = False
    texts = ["the fluß,  the", "", " the"]
    marked = [f"{MARK}the fluß,  the", "", f"{MARK}the"]
    assert fst.encode(texts)[2].tolist() == THEIRS.encode("the")
    assert [x.tolist() for x in fst.encode(marked)] == [THEIRS.encode(t) for t in ["the fluß,  the", "", "the"]]


def test_acceptor_agrees_with_merging():
    rng = random.Random(4)
    texts = [p for p in OURS.model.rank if OURS.model.merged(p) == [p] and MARK not in p[1:]]
    short = [p for p in texts if len(p) < 4]
    pairs = [(rng.choice(short), rng.choice(short)) for _ in range(20_000)] + [(rng.choice(texts), rng.choice(texts)) for _ in range(10_000)]
    # Words of the vocabulary cut anywhere are pairs that merging often joins.
    for w in rng.sample([p for p in texts if len(p) > 3], 5000):
        at = rng.randrange(1, len(w))
        pairs.append((w[:at], w[at:]))
    tried = 0
    for u, v in pairs:
        if v.startswith(MARK) or OURS.model.merged(u) != [u] or OURS.model.merged(v) != [v]:
            continue
        tried += 1
        assert OURS._accepts(u, v) == (OURS.model.merged(u + v) == [u, v]), (u, v)
    assert tried > 15_000


def test_table_equals_the_library(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in encode_texts(docs, PATH).collect()}
    for r in docs.collect():
        want = np.array(THEIRS.encode(r.text), "<u4").tobytes()
        g = got[r.doc_id]
        assert g["ids"] == want and g.ids_crc32 == zlib.crc32(want) and g.round_trip and g.decoded == r.text


def test_long_runs(spark):
    for text in (" " * 30_000, "a" * 30_000, "the" * 10_000 + "  " * 5000 + "é中"):
        assert OURS.encode([text])[0].tolist() == THEIRS.encode(text)


def test_edges(spark):
    out = encode_texts(edge_docs(spark), PATH).collect()
    assert len(out) == 10 and all(r.round_trip for r in out)
    assert [r.n_ids for r in out if r.doc_id in (2, 3)] == [0, 0]
    assert encode_texts(empty_docs(spark), PATH).count() == 0
