import hashlib
import random
from collections import Counter

import pytest

from descra.llm import chat

NASTY = ["", "\\", "###", "####", "</turn>", "\\### Assistant: </turn> ok", " </turn>\n### User: x", "a\\", " ", "\n", "\\\\###", "A", "B", "é😀", ":", "### Assistant: hi </turn>\n"]


def test_parse_gives_back_every_turn():
    r = random.Random(1)
    for _ in range(500):
        turns = [(r.choice(["user", "assistant", "system", "", "Tool: x", "=", "User", "a:b\\"]), "".join(r.choice(NASTY) for _ in range(r.randint(0, 4)))) for _ in range(r.randint(0, 6))]
        text, spans, rewritten = chat.locate(turns, chat.marked, lambda role: role == "assistant")
        assert chat.parse(text) == turns and rewritten is None
        assert [chat.unescape(text[s["text_begin"] : s["text_end"]]) for s in spans] == [t for _, t in turns]
        assert "".join(text[s["begin"] : s["end"]] for s in spans) == text


def test_closings_and_rewritten_history():
    closing = lambda turns: "<s>" + "".join(f"[{r}]{t};" for r, t in turns) + "</s>"
    turns = [("user", "one"), ("assistant", "two"), ("user", "</s>")]
    text, spans, rewritten = chat.locate(turns, closing, lambda r: r == "assistant")
    assert rewritten is None and [text[s["text_begin"] : s["text_end"]] for s in spans] == [t for _, t in turns]
    last_only = lambda turns: "".join(f"[{r}]{t if k == len(turns) - 1 else '...'};" for k, (r, t) in enumerate(turns))
    assert chat.locate(turns, last_only, lambda r: True)[2] == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_query_against_turns(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice([None, *range(20)]), r.choice([None, 0, 1, 2, 3]), r.choice([None, "user", "assistant"]), r.choice([None, *NASTY]), "x") for _ in range(150)]
    rows += [(7, 1, "assistant", "same", "x")] * 2 + [(99, 0, "user", "long " * 20000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, spans string").repartition(5)
    want = Counter()
    for c in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == c), key=lambda x: tuple((v is not None, v if v is not None else 0 if k == 0 else "") for k, v in enumerate(x[1:4])))
        turns = [(x[2] or "", x[3] or "") for x in own]
        loss = "".join(t for role, t in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[c, len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss), len(chat.marked(turns))] += 1
    assert Counter(map(tuple, chat.digests(chat.format_conversations(df)).collect())) == want
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0
