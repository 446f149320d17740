import pathlib
import sys

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from plumbline.llm import chat

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
import oracle  # noqa: E402

MARKS = ["[", "]", "<", ">", "/", "\\", "s>", "/s>", "</s>", "<s>", "[INST]", "[/INST]", "[TURN:", "[/TURN]", "INST]", "TURN:", " ", "\n", "é", "x", "user"]
texts = st.lists(st.sampled_from(MARKS), max_size=12).map("".join)
roles = st.one_of(st.sampled_from(["user", "assistant", "system", ""]), texts)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(roles, texts), max_size=6))
def test_round_trip(turns):
    template = chat.Tagged()
    whole, spans, rewritten, changed = chat.PrefixRenderer(template.render, template.escape).spans(turns, {"assistant"})
    assert whole == template.render(turns) and not rewritten and not changed
    assert [s["start"] for s in spans] + [len(whole)] == [0, *(s["end"] for s in spans)][: len(spans) + 1]
    assert [(template.role_of(whole[s["start"] : s["end"]]), template.unescape(whole[s["text_start"] : s["text_end"]])) for s in spans] == turns
    assert [s["loss"] for s in spans] == [r == "assistant" for r, _ in turns]
    for role, text in turns:
        assert not any(mark in template.escape(text) for mark in ("<s>", "</s>", "[INST]", "[/INST]", "[TURN:", "[/TURN]"))


def templates():
    class Forgetful:
        """Keeps the thoughts of the last assistant turn only."""

        def render(self, turns):
            last = max((n for n, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
            return "".join(f"<{r}>{t if n == last or r != 'assistant' else t.split('#')[-1]}\n" for n, (r, t) in enumerate(turns))

    class Trimming:
        def render(self, turns):
            return "".join(f"<{r}>{t.strip()}\n" for r, t in turns)

    class Numbered:
        def render(self, turns):
            return "".join(f"{n}:{r}:{t};" for n, (r, t) in enumerate(turns))

    return Forgetful, Trimming, Numbered


def test_templates_that_rewrite_or_change_are_reported(spark):
    Forgetful, Trimming, Numbered = templates()
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "why#b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"),
            (2, 0, "user", "a"), (2, 1, "assistant", "plain"), (2, 2, "assistant", "b"), (3, 0, "user", " x"), (3, 1, "user", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r for r in chat.formatted(turns, Forgetful()).collect()}
    assert got[1].rewritten == [3] and got[1].spans == [] and got[2].rewritten == [] and len(got[2].spans) == 3
    got = {r.conv_id: r for r in chat.formatted(turns, Trimming()).collect()}
    assert got[3].changed == [0] and got[3].spans == [] and got[3].rewritten == [] and len(got[1].spans) == 4
    one = {r.conv_id: r for r in chat.formatted(turns, Numbered(), loss_roles=("user",)).collect()}[3]
    assert [(one.formatted[s.start : s.end], one.formatted[s.text_start : s.text_end], s.loss) for s in one.spans] == [("0:user: x;", " x", True), ("1:user:y;", "y", True)]


def test_cases(spark):
    rows = [(1, 2, "assistant", None), (1, None, None, "first"), (1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"),
            (None, 0, "user", "n"), (None, 1, "assistant", "m"), (0, 0, "assistant", "zero"), (2, 0, "assistant", "é" * 200_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("spans", F.lit(1)).withColumn("none", F.lit(2))
    done = chat.formatted(turns)
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.loss_text) for r in chat.read_back(done).collect()}
    assert got.pop(2)[1] == "é" * 200_000
    assert got == {1: ([("", "first"), ("user", "a"), ("user", "a"), ("user", "b"), ("assistant", "")], ""),
                   None: ([("user", "n"), ("assistant", "m")], "m"), 0: ([("assistant", "zero")], "zero")}
    assert chat.read_back(chat.formatted(turns.limit(0))).count() == 0


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    query, sql = chat.QUERIES["op12_chat"]
    assert oracle.compare(spark, oracle.connect(folder), query, sql, folder) is None
