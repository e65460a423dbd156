import hashlib
import random
from collections import defaultdict

from swathgrid.llm.chat import chat_digest, chat_windows, read_turns

NASTY = ["</turn>\n<turn assistant>", "\\", "\\l<\\g>", "a\\", "<turn again user>x</turn>\n", "", "é\U0001f600", "### x"]
SCHEMA = "conv_id long, turn long, role string, text string, window long, part string"


def rows():
    out = []
    for c in range(12):
        for t in range(c * 3):
            role = "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2]
            out.append((c, t, role, (NASTY[(c + t) % len(NASTY)] + " w") * (1 + 7 * t % 40), 1, "z"))
    out += [(50, 0, "user", None, None, None), (50, 0, "user", None, None, None), (50, 1, None, "x", 1, None)]
    out += [(51, t, "assistant", "word " * 50, None, None) for t in range(3000)]
    out += [(52, 0, "again user", "x", None, None), (52, 1, "again <user>", "y", None, None), (None, 0, "assistant", "q", 0, "")]
    out += [(53, 0, "assistant", "long " * 5000, 0, ""), (53, 1, "assistant", "tail", 0, "")]
    return out


def test_round_trip_and_mask(spark):
    said = rows()
    got = {r.conv_id: r for r in chat_digest(chat_windows(spark.createDataFrame(said, SCHEMA), 100, 30)).collect()}
    for conv in {r[0] for r in said}:
        turns = sorted((t, r or "", x or "") for c, t, r, x, *_ in said if c == conv)
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got.pop(conv)
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest()), conv
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()), conv
    assert not got


def test_windows_keep_system_and_history_within_reach(spark):
    said = [(1, 0, "system", "be kind")] + [(1, t, ("user", "assistant")[t % 2], f"turn {t} " * 10) for t in range(1, 60)]
    out = chat_windows(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"), 150, 60)
    windows = sorted(out.collect(), key=lambda r: r.window)
    assert len(windows) > 5
    for w in windows[1:]:
        turns = list(read_turns(w.text))
        assert turns[0] == (True, "system", "be kind")
        past = [t for t in turns[1:] if t[0]]
        assert 1 <= len(past) <= 2 and not any(t[0] for t in turns[1 + len(past) :])
        assert len(w.mask) == sum(not a and r == "assistant" for a, r, _ in turns)


def tokens(turn):
    return len(turn[1].split()) + 4


def brute(turns, budget, history, stretch):
    """Windows of one conversation as lists of (repeated, role, text), straight from the definition."""
    first = [sum(map(tokens, turns[:i])) for i in range(len(turns))]
    system = next((i for i, t in enumerate(turns) if t[0] == "system"), None)
    out, i = [], 0
    while i < len(turns):
        head = [system] if system is not None and system < i else []
        space = budget - sum(tokens(turns[h]) for h in head)
        reach = min(history, space - tokens(turns[i]))
        past = [j for j in range(i) if first[i] - first[j] <= reach]
        space -= first[i] - first[past[0]] if past else 0
        end = i + 1
        while end < len(turns) and first[end] // stretch == first[i] // stretch and first[end] + tokens(turns[end]) - first[i] <= space:
            end += 1
        again = head + [j for j in past if j not in head]
        out.append([(True, *turns[j]) for j in again] + [(False, *t) for t in turns[i:end]])
        i = end
    return out


def test_windows_follow_the_definition_and_keep_the_budget(spark):
    rng = random.Random(3)
    said = []
    for c in range(60):
        at = rng.choice([None, 0, 0, 3])
        for t in range(rng.choice([1, 2, 9, 150])):
            role = "system" if t == at else ("user", "assistant")[t % 2]
            said.append((c, t, role, "w " * rng.choice([0, 1, 5, 20, 40, 46, 47, 90, 96, 97, 300])))
    said += [(90, 0, "user", "w " * 376), (90, 1, "assistant", "w " * 376)]
    out = chat_windows(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"), 100, 50).collect()
    got, alone = defaultdict(list), 0
    for w in sorted(out, key=lambda r: (r.conv_id, r.window)):
        turns = list(read_turns(w.text))
        got[w.conv_id].append(turns)
        own = [t for t in turns if not t[0]]
        size = sum(tokens(t[1:]) for t in turns)
        alone += size > 100
        assert size <= 100 or len(own) == 1 and all(t[1] == "system" for t in turns if t[0])
        assert [w.text[a:b] for a, b in w.mask] == [t[2] for t in own if t[1] == "assistant"]
    for c in {x[0] for x in said}:
        assert got[c] == brute([x[2:] for x in said if x[0] == c], 100, 50, 1600), c
    assert len(got[90]) == 2 and alone and len(out) - alone > 500


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat_windows(empty).count() == 0 and chat_digest(chat_windows(empty)).count() == 0
