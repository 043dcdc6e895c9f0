import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from lexispark.llm.chat_format import escape, format_chats, read_back, read_turns, render, unescape
from lexispark.llm.queries import op9_chat_format, tokenizer_path
from tokenizers import Tokenizer

PATH = tokenizer_path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def digests(turns):
    all_, loss = hashlib.sha256(), ""
    for role, text in turns:
        all_.update(f"{role}\n{text}\n".encode())
        loss += text if role == "assistant" else ""
    return len(turns), all_.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def check(df, got):
    convs = {}
    for r in df.collect():
        convs.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    key = lambda t: (t[0] is not None, t[0] or 0, t[1], t[2])
    want = {c: digests([t[1:] for t in sorted(turns, key=key)]) for c, turns in convs.items()}
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == want


def test_whole_table(spark, data):
    c = spark.read.parquet(f"{data}/conversations.parquet")
    got = op9_chat_format(spark, data).collect()
    check(c, [r for r in got if r["conv_id"] != -7])
    said = "\\### Assistant: </turn> ok"
    [extra] = [r for r in got if r["conv_id"] == -7]
    assert (
        extra["n_turns"], extra["turns_sha256"], extra["loss_chars"], extra["loss_sha256"]
    ) == digests([("user", said), ("assistant", said)])


def test_windows(spark):
    rng = random.Random(3)
    rows = [(1, 0, "system", "be brief")] + [
        (1, t, "user" if t % 2 else "assistant", " ".join(["w"] * rng.randint(1, 60))) for t in range(1, 80)
    ] + [(2, 1, "assistant", "x " * 500)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    windows = format_chats(df, PATH, budget=120, history_turns=2, history_tokens=60).collect()
    check(df, read_back(format_chats(df, PATH, budget=120, history_turns=2, history_tokens=60)).collect())
    for w in windows:
        turns = read_turns(w["text"])
        assert w["n_tokens"] == len(LIB.encode(w["text"], add_special_tokens=False).ids)
        assert len(turns) == w["n_turns"] and (w["n_tokens"] <= 120 or w["n_turns"] - w["n_repeated"] == 1)
        if w["conv_id"] == 1 and w["window_no"]:
            assert turns[0] == ("system", "be brief") and 1 <= w["n_repeated"] <= 3
        assert [unescape(w["text"][a:b]) for a, b in w["loss"]] == [
            t for r, t in turns[w["n_repeated"] :] if r == "assistant"
        ]


def test_odd_rows(spark):
    rows = [
        (1, 1, None, None), (1, 1, "a:b# ### x", "### user: \\ </turn>\n"), (1, None, "assistant", ""),
        (1, 1, "assistant", "t"), (1, 1, "assistant", "t"), (None, 2, "assistant", "😀" * 9), (None, None, None, None),
        (3, 1, "user", "y " * 50_000)
    ]
    df = spark.createDataFrame(
        rows, "conv_id bigint, turn bigint, role string, text string"
    ).selectExpr("*", "1 AS window_no", "2 AS loss")
    check(df, read_back(format_chats(df, PATH)).collect())
    assert read_back(format_chats(df.where("false"), PATH)).count() == 0


def test_texts_without_spaces_fill_a_budget(spark):
    """What has no white space has tokens all the same."""
    rows = [(1, t, "assistant", "ab1x" * 400) for t in range(12)]
    windows = format_chats(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), PATH).collect()
    assert len(windows) > 4 and all(w["n_tokens"] <= 1024 or w["n_turns"] - w["n_repeated"] == 1 for w in windows)


def test_windows_in_any_stored_order_and_ids_of_text(spark, tmp_path):
    rng = random.Random(4)
    rows = [
        (None if c == 3 else f"c{c}", t, rng.choice(["user", "assistant"]), "word " * rng.randint(1, 90))
        for c in range(5) for t in range(60)
    ]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    format_chats(df, PATH, budget=100).orderBy("text").write.parquet(str(tmp_path / "w"))
    stored = spark.read.parquet(str(tmp_path / "w"))
    assert stored.count() > 200
    check(df, read_back(stored.orderBy("n_tokens")).collect())


@given(st.lists(st.tuples(st.text(max_size=12), st.text(max_size=40)), max_size=5))
def test_round_trip(turns):
    assert read_turns("".join(render(r, t)[0] for r, t in turns)) == turns
    assert all(unescape(escape(t)) == t for _, t in turns)


def test_large_ids_beside_a_null(spark):
    """Ids that a floating-point number can't tell apart stay apart, beside a null and in any type."""
    big = 2**53
    rows = [(big, 0, "user", "a"), (big + 1, 0, "user", "b"), (None, 0, "user", "c"), (-(2**63), 0, "assistant", "d")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r["n_turns"] for r in read_back(format_chats(turns, PATH)).collect()}
    assert got == {big: 1, big + 1: 1, None: 1, -(2**63): 1}
    for kind in ("string", "decimal(38,0)"):
        other = format_chats(turns.withColumn("conv_id", turns["conv_id"].cast(kind)), PATH)
        assert read_back(other).count() == 4 and dict(other.dtypes)["conv_id"] == kind
