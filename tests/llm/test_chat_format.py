import random
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from ledgerlight.llm import chat_format as c


def model(seed):
    rng = np.random.default_rng(seed)
    log = lambda a: np.log(a / a.sum(-1, keepdims=True))
    return c.Model(log(rng.random(4)), log(rng.random((4, 4))), [log(rng.random((4, n))) for n in c.SIZES])


def test_path_is_the_best_of_all():
    m = model(1)
    rng = np.random.default_rng(2)
    for n in (1, 2, 5):
        obs = np.stack([rng.integers(0, k, n) for k in c.SIZES], 1)
        scores = m.scores(obs)
        best = max(product(range(4), repeat=n), key=lambda p: m.start[p[0]] + sum(m.step[a, b] for a, b in zip(p, p[1:])) + sum(scores[i, k] for i, k in enumerate(p)))
        assert c.best_path(m.steps, scores, 4) == list(best)


def rows(seed, convs=80):
    rng = random.Random(seed)
    out = []
    for i in range(convs):
        role = "user"
        turns = ["system"] if i % 4 == 0 else []
        for _ in range(rng.randrange(1, 9)):
            turns.append(role)
            role = "assistant" if role == "user" else "user"
        for t, r in enumerate(turns):
            body = {"system": "You are helpful.", "user": "what is this?", "assistant": "An answer that is long. " * 12}[r]
            mark = {"system": "### System:", "user": rng.choice(["User:", "Human:"]), "assistant": "Assistant:"}[r] if i % 3 else ""
            out.append((i, t, r, f"{mark} {body}".strip()))
    return out


def best_of_all(m, obs):
    scores = m.scores(np.array(obs))
    return max(product(range(4), repeat=len(obs)), key=lambda p: m.start[p[0]] + sum(m.step[a, b] for a, b in zip(p, p[1:])) + sum(scores[i, k] for i, k in enumerate(p)))


def test_transcripts_are_cut_at_markers_only():
    texts = {
        "User: how are you?\nAssistant: I am well.\nUser: good.": [2, 3, 2],
        "<|im_start|>system\nBe brief.<|im_end|>\n<|im_start|>user\nhi<|im_end|>": [1, 2],
        "no marker\nat all": [0],
        "### Assistant:\nlook:\n```\nUser: not me\n```\n> User: nor me\n[USER] yes": [3, 2],
        "**Bot:** hi\n**User:** and you?": [3, 2],
        "the user: of a thing": [0],
        "Please check this order.\nCustomer: ACME\nModel: X100\nFunction: pump\nAgent: Smith": [0],
        "Customer: ACME\nModel: X100\nFunction: pump": [2],
        "User: which one?\nAssistant: this:\nFunction: pump\nAnswer: 42\nUser: thanks": [2, 3, 2],
        "Q: one?\nA: yes\nQ: two?\nA: no": [2, 3, 2, 3],
        "Human: a\nAI: b\nUser: c\nAssistant: d": [2, 3, 2, 3],
        "look\nuser: a\nbot: b\nuser: c": [0, 2, 3, 2],
        "[USER] a\nModel: b": [2, 3],
        "```\n" * 30_001 + "User: a": [0],
        "": [0],
    }
    for text, who in texts.items():
        found = c.parts(text)
        assert [c.features(*x)[0] for x in found] == who and "".join(a + b for a, b in found) == text


def test_whole_transcripts_against_all_paths(spark):
    rng = random.Random(4)
    said = {"system": "You are brief.", "user": "what is this?", "assistant": "It is a long story. " * 6}
    data = [(i, t, r, said[r]) for i in range(60) for t, r in enumerate((["system"] if i % 3 == 0 else []) + ["user", "assistant"] * rng.randrange(1, 3))]
    names = {"user": ["User: ", "**Human:** ", "[USER] "], "assistant": ["Assistant: ", "### Bot:\n", "AI: "], "system": ["System: "]}
    for i in range(100, 160):  # one row holds it all, now and then without a marker
        turns = ["user", "assistant"] * rng.randrange(1, 3)
        data.append((i, 0, None, "\n".join((rng.choice(names[r]) if k == 0 or rng.random() < 0.9 else "") + said[r] for k, r in enumerate(turns))))
    data.append((200, 0, None, "User: how are you?\nAssistant: I am well.\nAnswer: 42\nUser: good."))
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")
    turns = c.placed(c.parsed(c.rows_of(df, "conv_id", "turn", "role", "text")), 4).withColumn("fold", F.crc32(F.col("conv").cast("string").cast("binary")) % 5)
    model_of = c.train(turns.where("fold <> 0"))
    got = {}
    for r in c.chat_turns(df, per_block=4).collect():
        got.setdefault(r.conv_id, []).append(r)
    for conv in got:
        cut = [p for row in sorted(x for x in data if x[0] == conv) for p in c.parts(row[3])]
        obs = [[*c.features(*p), int(k == 0)] for k, p in enumerate(cut)]
        rows = sorted(got[conv], key=lambda r: (r.turn, r.part))
        assert [r.role for r in rows] == [c.ROLES[k] for k in best_of_all(model_of, obs)]
    last = sorted(got[200], key=lambda r: r.part)
    assert [r.role for r in last] == ["user", "assistant", "user"]
    assert "".join(r.rendered + "|" for r in last) == "<|user|>\nhow are you?\n<|end|>|<|assistant|>\nI am well.\nAnswer: 42\n<|end|>|<|user|>\ngood.\n<|end|>|"


def test_roles_are_recovered_in_blocks_of_any_size(spark):
    data = rows(3)
    data += [(900, t, "user" if t % 2 == 0 else "assistant", "User: hm?" if t % 2 == 0 else "Because. " * 40) for t in range(300)]
    data += [(None, 0, "user", "User: alone?"), (None, 0, "user", None), (901, None, None, "Assistant: so"), (901, 0, "nobody", ""), (902, 1, "user", "x"), (902, 1, "user", "x")]
    df = spark.createDataFrame([(*r, "g", 1, 2) for r in data], "conv_id bigint, turn bigint, role string, text string, group string, place int, block int")
    answers = []
    for per_block in (4, 512):
        got = c.chat_turns(df, per_block=per_block).collect()
        assert sum(r.part == 0 for r in got) == len(data)
        answers.append(sorted(map(str, got)))
    assert answers[0] == answers[1]
    held = [r for r in got if r.held_out and r.given_role]
    assert held and sum(r.role == r.given_role for r in held) >= 0.97 * len(held)
    one = [r for r in got if r.conv_id == 1]
    assert one[0].rendered.startswith("<|user|>\nwhat is this?") and one[0].rendered.endswith("<|end|>")
    assert c.chat_turns(df.limit(0)).count() == 0
    as_text = spark.createDataFrame([("a", "first", "user", "hi"), ("a", "second", None, "x" * 200_000), ("a", None, "user", "User: so")], "conv_id string, turn string, role string, text string")
    assert [(r.turn, len(r.rendered) > 100_000) for r in c.chat_turns(as_text).collect() if r.turn == "second"] == [("second", True)]


def test_no_text_is_lost(spark):
    """Whatever roles are found, rendered turns hold every word of their row but markers that name the role found."""
    form = "Please check this order.\nCustomer: ACME\nModel: X100\nFunction: pump\nAgent: Smith"
    data = [(1, 0, None, form), (2, 0, None, "Model: X100 is what you want"), (3, 0, None, "Q: is it?"), (3, 1, None, "A: it is"), (4, 0, None, "User: hi\nAssistant: hello\nTool: 7\nAssistant: so 7\nUser: thanks"), (5, 0, None, "Function: pump")]
    data += [(i + 10, t, r, {"user": "what is this?", "assistant": "It is a long story. " * 6}[r]) for i in range(40) for t, r in enumerate(("user", "assistant"))]
    got = {}
    for r in c.chat_turns(spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")).orderBy("conv_id", "turn", "part").collect():
        got.setdefault(r.conv_id, []).append(r)
    assert len(got[1]) == 1 and form in got[1][0].rendered
    assert "Model: X100 is what you want" in got[2][0].rendered and "Function: pump" in got[5][0].rendered  # the only marker there, and a noun
    assert [(r.role, r.rendered) for r in got[3]] == [("user", "<|user|>\nis it?\n<|end|>"), ("assistant", "<|assistant|>\nit is\n<|end|>")]
    for conv in got:
        for r, (marker, body) in zip(got[conv], [p for row in data if row[0] == conv for p in c.parts(row[3])], strict=True):
            assert body.strip() in r.rendered
            assert not marker.strip() or marker.strip() in r.rendered or c.ROLES[c.features(marker, body)[0] - 1] == r.role
