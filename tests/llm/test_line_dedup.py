from collections import Counter, defaultdict

from helpers import docs_of, documents, edge_docs, empty_docs

from swathgrid.llm.line_dedup import drop_recurring_lines, tokens
from swathgrid.llm.queries import QUERIES


def brute(rows, min_docs=5, min_tokens=3, depth=3, similar=0.8, constants=4, short_docs=50, long_tokens=50, long_docs=None):
    def needed(n):
        return max(short_docs, min_docs) if n < min_tokens else long_docs if long_docs and n >= long_tokens else min_docs

    lines = {(i, n): tuple(tokens(x)) for i, t in rows for n, x in enumerate((t or "").split("\n"))}
    lines = {k: v for k, v in lines.items() if v}
    docs = defaultdict(set)
    for (i, _), v in lines.items():
        docs[v].add(i)
    gone = {k for k, v in lines.items() if len(docs[v]) >= needed(len(v)) and k[0] != min(docs[v])}
    leaves = defaultdict(list)
    for k, v in lines.items():
        if len(docs[v]) < needed(len(v)) and len(v) >= min_tokens:
            leaves[len(v), v[:depth]].append(k)
    for own in leaves.values():
        ids = {i for i, _ in own}
        if len(ids) < min_docs:
            continue
        n, template = len(lines[own[0]]), {}
        for p in range(n):
            best = Counter(x for _, x in {(i, lines[i, m][p]) for i, m in own})
            token, count = best.most_common(1)[0]
            if 2 * count >= len(ids):
                template[p] = token
        enough, ok = max(constants, -(-n * 6 // 10)), []
        if len(template) >= enough:
            ok = [k for k in own if sum(lines[k][p] == t for p, t in template.items()) >= -(-len(template) * 8 // 10)]
        found = {i for i, _ in ok}
        if len(found) >= min_docs:
            gone |= {k for k in ok if k[0] != min(found)}
            own = sorted(set(own) - set(ok))
        gone |= further(lines, own, min_docs, enough)
    return {i: "\n".join(x for n, x in enumerate((t or "").split("\n")) if (i, n) not in gone) for i, t in rows}


def further(lines, own, min_docs, enough):
    """Lines whose tokens in 5, 10, 20, .. documents of the leaf are those of 5 documents or more."""
    seen, families = defaultdict(set), defaultdict(set)
    for k in own:
        for place in enumerate(lines[k]):
            seen[place].add(k[0])
    least = min_docs
    while any(len(x) >= least for x in seen.values()):
        for k in own:
            fixed = tuple(place for place in enumerate(lines[k]) if len(seen[place]) >= least)
            if len(fixed) >= enough:
                families[fixed].add(k)
        least *= 2
    large = [x for x in families.values() if len({i for i, _ in x}) >= min_docs]
    return {k for x in large for k in x if k[0] != min(x)[0]}


def same(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for long_docs in (2, None):
        got = {r.doc_id: r.text or "" for r in drop_recurring_lines(docs, long_docs=long_docs).collect()}
        assert got == brute(rows, long_docs=long_docs)
    return got


def test_table_matches_brute_force(spark):
    docs = documents(spark)
    got = same(spark, docs)
    assert sum(map(len, got.values())) < sum(len(r.text) for r in docs.collect())


def test_fields_and_varying_tokens_are_generalised(spark):
    names = "ann bob cid dan eve fay gus hal".split()
    texts = [f"body {n} one\nshared on page {i} of {i * 3}\nsigned by the editor {n} of this very paper" for i, n in enumerate(names)]
    got = same(spark, docs_of(spark, texts))
    assert got[0] == texts[0] and got[5] == "body fay one"


def test_few_documents_or_short_lines_are_kept(spark):
    texts = ["a b c d e f g"] * 4 + ["x y"] * 30
    assert same(spark, docs_of(spark, texts)) == dict(enumerate(texts))


def test_long_passages_and_frequent_short_lines_are_dropped(spark, tmp_path):
    names = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(60)]
    passage = " ".join(f"word{chr(97 + i % 26)}" for i in range(55))
    texts = [f"only {n} {n}{n}\nGo." for n in names] + [f"first {n}\n{passage}\nlast {n}" for n in "xy"]
    texts += ["just five\n" + " ".join(passage.split()[:20])] * 4
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op7_line_dedup"][0](spark, str(tmp_path)).collect()}
    assert [got[i].n_chars_left for i in (0, 1, 59)] == [len(texts[0]), len(texts[1]) - 4, len(texts[59]) - 4]
    assert [got[i].n_chars_left for i in (60, 61)] == [len(texts[60]), len("first y\nlast y")]
    assert [got[i].n_chars_left for i in range(62, 66)] == [len(texts[62])] * 4


def test_a_leaf_holds_several_templates(spark):
    names = [chr(97 + i // 26) + chr(97 + i % 26) + "q" for i in range(60)]
    kinds = [
        "note from the {} office about lost keys found today",
        "note from the {} school about new books bought monday",
        "note from the {} garden about old trees felled again",
    ]
    prose = [" ".join(["note", "from", "the"] + [f"{n}{chr(97 + k)}" for k in range(7)]) for n in names]
    # Every name occurs in four lines of each kind, so it is frequent in the leaf itself.
    texts = [k.format(names[i % 10]) for k in kinds for i in range(40)] + prose
    got = same(spark, docs_of(spark, texts))
    assert sorted(i for i, t in got.items() if i < 120 and t) == [0, 40, 80]
    assert all(got[120 + i] == t for i, t in enumerate(prose))


def test_edges(spark):
    out = drop_recurring_lines(edge_docs(spark), min_docs=2)
    assert out.columns == edge_docs(spark).columns and out.count() == 10
    assert {r.doc_id: r.text for r in out.collect()}[2] is None
    assert {r.doc_id: r.text for r in out.collect()}[5] == ""
    assert drop_recurring_lines(empty_docs(spark)).count() == 0
