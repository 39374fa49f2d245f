"""The classifier over whole turns, through the registered query."""

from docquarry.plans.catalogue import QUERIES


def test_whole_turns(spark, tmp_path):
    said = ["Good morning!", "Thank you so much", "what can I ask?", "Hi, what is the notice period?", "Hi!", ""]
    rows = [(1, i, "user", t) for i, t in enumerate(said)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r.kind for r in QUERIES["message_kinds"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(said))] == ["greeting", "thanks", "meta", "question", "greeting", "question"]
