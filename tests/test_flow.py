"""A question from its text to the saved exchange."""

import pytest

from docquarry.operators import flow as W
from docquarry.operators.answers import hashing_embedder

PASSAGE = "workspace_id string, document_id long, ordinal int, filename string, status string, header string, section string, content string, tags map<string,string>, embedding array<float>"
EMBED = hashing_embedder(32)


@pytest.fixture
def tables(spark):
    text = {1: "the tower is tall and old", 2: "bridges cross the river", 3: "the tower was built by masons", 4: "a tower in another town"}
    rows = [("w", i, 0, f"f{i}.txt", "ready" if i != 3 else "pending", f"f{i}.txt", "", t, None, EMBED([t])[0].tolist()) for i, t in text.items() if i < 4]
    rows.append(("v", 4, 0, "f4.txt", "ready", "f4.txt", "", text[4], None, EMBED([text[4]])[0].tolist()))
    spaces = spark.createDataFrame([("w", ["f1.txt", "f2.txt"], [], 1), ("v", ["f4.txt"], [], 0), ("u", [], [], 0)], "workspace_id string, names array<string>, topics array<string>, processing int")
    messages = spark.createDataFrame([("w", 7, 0, "user", "before"), ("w", 7, 1, "assistant", "yes"), ("v", 7, 0, "user", "x")], "workspace_id string, user_id long, turn long, role string, content string")
    return spark.createDataFrame(rows, PASSAGE), spaces, messages


def ask(tables, workspace, question, reply, seen=None):
    def complete(prompt):
        if seen is not None:
            seen.append(prompt)
        return reply

    return W.ask(*tables, workspace, 7, question, lambda q: EMBED([q])[0].tolist(), complete)


def saved(done, workspace):
    return [(r.turn, r.role, r.content) for r in done.messages.where(f"workspace_id = '{workspace}'").orderBy("turn").collect()]


def test_a_question_is_answered_cited_and_saved(tables):
    seen = []
    done = ask(tables, "w", "How tall is the tower?", " It is tall [1][9]. ", seen)
    assert (done.route, done.text, done.refused) == ("question", "It is tall [1][9].", False)
    assert [(r.rank, r.number, r.document_id, r.filename) for r in done.cited.collect()] == [(0, 1, 1, "f1.txt")]
    assert saved(done, "w") == [(0, "user", "before"), (1, "assistant", "yes"), (2, "user", "How tall is the tower?"), (3, "assistant", "It is tall [1][9].")]
    assert "[1] f1.txt\nthe tower is tall and old" in seen[0] and "masons" not in seen[0] and "another" not in seen[0]


@pytest.mark.parametrize("reply", ["", None, "Sorry, that is NOT IN THE DOCUMENTS."])
def test_a_reply_without_an_answer_is_the_refusal(tables, reply):
    done = ask(tables, "w", "tower?", reply)
    assert (done.text, done.refused, done.cited.count()) == (W.REFUSAL, True, 0)
    assert saved(done, "w")[-1] == (3, "assistant", W.REFUSAL)


def test_small_talk_and_empty_workspaces_ask_nobody(tables):
    seen = []
    done = ask(tables, "w", "Hello there!", "never", seen)
    assert done.route == "greeting" and "f1.txt" in done.text and not done.refused and done.cited.count() == 0
    assert len(saved(done, "w")) == 4
    done = ask(tables, "u", "how tall?", "never", seen)
    assert (done.route, done.text, done.refused) == ("question", W.REFUSAL, True) and saved(done, "u") == [(0, "user", "how tall?"), (1, "assistant", W.REFUSAL)]
    assert seen == []
