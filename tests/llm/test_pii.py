import re

from helpers import docs_of, documents, edge_docs, empty_docs

from swathgrid.llm.pii import KINDS, find_pii, hidden, joined, luhn, mask_pii, masked, plain
from hypothesis import given, settings
from hypothesis import strategies as st

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [(*m.span(), "email") for m in EMAIL.finditer(text)]
    out += [(*m.span(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@-+% (0259\nа", max_size=40))
def test_plain_matches_the_patterns(text):
    assert sorted(plain(text)) == brute(text)


def test_table_matches_the_patterns(spark):
    docs = documents(spark)
    for row, got in zip(
        docs.select("doc_id", "text").orderBy("doc_id").collect(), find_pii(docs).orderBy("doc_id").collect(), strict=True
    ):
        base = brute(row.text)
        assert got.base == joined(base)
        assert [got[f"n_{k}"] for k in KINDS] == [sum(x[2] == k for x in base) for k in KINDS]
        assert set(filter(None, got.base.split(","))) <= set(got.spans.split(","))


def spans(text):
    return [(text[s:e], k) for s, e, k in hidden(text, plain(text))]


def test_disguises_map_back_to_the_source():
    assert spans("mail j.doe [at] example (dot) org now") == [("j.doe [at] example (dot) org", "email")]
    assert spans("mail jane at example dot co dot uk now") == [("jane at example dot co dot uk", "email")]
    assert spans("x jоe@exаmple.com y") == [("jоe@exаmple.com", "email")]
    assert spans("ip １９２.168.１.7!") == [("１９２.168.１.7", "ip")]
    call = "call plus one five five five two three four five six seven eight today"
    assert spans(call) == [("plus one five five five two three four five six seven eight", "phone")]
    card = "four one one one " * 1 + "one one one one one one one one one one one one"
    assert spans(card) == [(card, "card")]


def test_invisible_characters():
    text = "a joe@example​.com b"
    assert [text[s:e] for s, e, _ in hidden(text, plain(text))] == ["joe@example​.com"]


def test_hidden_finds_that_hold_a_plain_one_are_added():
    for text in ("jоhn.doe@example.com", "joe@example.cоm", "joe\u200be@example.com"):
        assert plain(text) and spans(text) == [(text, "email")]
        assert masked(f"to {text} now") == "to [EMAIL] now"
    assert spans("jоe and joe@example.com") == []


def test_mixed_disguises():
    for text in (
        "john (at) example dot com", "john at example[.]com", "john at example.com", "john@example dot com",
        "john at example dot online", "john [at] example dot museum", "john at example[.]museum", "j@mail.example dot co dot uk",
    ):
        assert spans(f"to {text} now") == [(text, "email")], text
    assert spans("ip 192 dot 168 dot 1 dot 1 up") == [("192 dot 168 dot 1 dot 1", "ip")]
    assert spans("ip 192[.]168 dot 1.1!") == [("192[.]168 dot 1.1", "ip")]
    assert spans("call +1 five 55 0199 1234 now") == [("+1 five 55 0199 1234", "phone")]
    for text in ("look at example.com now", "he arrived at noon.In the end", "joe@example.com dot the i", "ip 1 dot 2 dot 3 dot 400"):
        assert spans(text) == [], text


def test_prose_is_left_alone():
    for text in ("look at the dot on the map", "one two many", "at (dot) x", "éè ñ café at noon. dot"):
        assert spans(text) == []


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" + "(" * 400_000, "@" * 300_000, "1 " * 200_000, " dot " * 60_000):
        hidden(text, plain(text))


def test_long_spoken_runs_take_linear_time():
    for text in ("a at b." * 60_000, "a@b dot c " * 40_000, "1 dot " * 60_000, "a@" * 200_000, "one 1 " * 60_000, "at a." * 80_000):
        hidden(text, plain(text))


def test_edges_and_masking(spark):
    assert find_pii(edge_docs(spark)).count() == 10
    assert find_pii(empty_docs(spark)).count() == 0
    docs = docs_of(spark, ["a@b.co and 1.2.3.4", None, "plain"])
    assert [r.text for r in mask_pii(docs).orderBy("doc_id").collect()] == ["[EMAIL] and [IP]", None, "plain"]
    assert mask_pii(edge_docs(spark)).columns == edge_docs(spark).columns
    assert masked("joe [at] x [dot] org!") == "[EMAIL]!"
