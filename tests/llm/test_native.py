"""Chat formatting, decontamination, mixing and quality rules against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.llm import chat, decontaminate, mixing, rules
from tidemark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = "\\### Assistant: </turn> ok"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1_reads_back_every_conversation(spark):
    rows = [r for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    by = defaultdict(list)
    for r in rows:
        by[r.conv_id].append((r.turn, r.role, r.text or ""))
    by[-7] = [(0, "user", ODD), (1, "assistant", ODD)]
    got = {r.conv_id: r for r in QUERIES["op1_chat_format"](spark, SMALL).collect()}
    assert set(got) == set(by)
    for k, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[k].n_turns == len(turns) and got[k].turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, r, t in turns))
        assert got[k].loss_chars == len(loss) and got[k].loss_sha256 == sha(loss)
        assert got[k].formatted_chars > sum(len(t) for _, _, t in turns)


NASTY = ["", "\\", "\\\\", "###", "####", "#####", "</turn>", "<\\/turn>", "\\###\\", "### User: a</turn>\n### Assistant: b</turn>\n", "a\nb\r\n", "x" * 200_000, "é😀", "#\\##", "<", "</turn", None]


def test_op1_escapes_are_reversible(spark):
    rows = [(1, i, role, t) for i, (t, role) in enumerate((t, role) for t in NASTY for role in ("user", "assistant", "a: b", "=x", "###", None, "User"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(chat.canonical(df, ("conv_id", "turn")), "conv_id", ["turn"])
    r = out.withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments"))).first()
    assert [(t.role, t.text) for t in r.back] == [(role or "", t or "") for _, _, role, t in rows]
    assert r.loss == "".join(t or "" for _, _, role, t in rows if role == "assistant")
    assert "".join(s.text for s in r.segments) == r.formatted


def test_op1_layouts_by_fingerprint(spark):
    df = spark.createDataFrame(
        [(1, [("q", "user"), ("a", "assistant")], None, None, None, None, None, None), (2, None, [("human", "q"), ("gpt", "a")], None, None, None, None, None),
         (3, None, None, "do", "with", "done", None, None), (4, None, None, "do", None, "done", None, None), (5, None, None, None, None, None, "p", "c"), (6, None, None, None, None, None, None, "c"),
         (7, [(None, None)], None, None, None, None, None, None)],
        "id long, messages array<struct<content:string,role:string>>, conversations array<struct<`from`:string,value:string>>, instruction string, input string, output string, prompt string, completion string")
    got = {r.id: (r.layout, [(t.role, t.text) for t in r.turns]) for r in chat.canonical(df.withColumn("other", F.lit("x")), ("id",)).collect()}
    assert got[1] == ("messages", [("user", "q"), ("assistant", "a")]) and got[2] == ("sharegpt", [("user", "q"), ("assistant", "a")])
    assert got[3] == ("instruction", [("user", "do\n\nwith"), ("assistant", "done")]) and got[4] == ("instruction", [("user", "do"), ("assistant", "done")])
    assert got[5] == ("prompt_completion", [("user", "p"), ("assistant", "c")]) and got[6] == (None, []) and got[7] == (None, [])


def test_op1_further_fields_hide_no_record(spark):
    """A further field of a message, a system prompt beside messages, columns of another layout; and unknown layouts stay as rows."""
    df = spark.createDataFrame(
        [(1, [("q", "user", "Ann"), ("a", "assistant", None)], None, None, None, None, None), (2, [("q", "user", None)], "be kind", None, None, None, None), (3, None, None, "what?", None, "user", "hi"),
         (4, None, None, "what?", "that", None, None), (5, None, None, None, "only an answer", None, None), (6, None, None, None, None, None, None), (7, [("q", "user", None)], None, "what?", "that", None, None)],
        "id long, messages array<struct<content:string,role:string,name:string>>, system string, question string, answer string, role string, text string").withColumn("fingerprinted", F.lit("x"))
    turns = chat.canonical(df, ("id",))
    got = {r.id: (r.layout, [(t.role, t.text) for t in r.turns]) for r in turns.collect()}
    assert got == {1: ("messages", [("user", "q"), ("assistant", "a")]), 2: ("messages", [("system", "be kind"), ("user", "q")]), 3: ("turn_row", [("user", "hi")]), 4: ("question_answer", [("user", "what?"), ("assistant", "that")]),
                   5: (None, []), 6: ("turn_row", [("", "")]), 7: ("messages", [("user", "q")])}
    out = {r.id: r for r in chat.format_chats(turns, "id", []).collect()}
    assert set(out) == set(range(1, 8)) and out[5].formatted is None and out[5].segments == [] and out[2].formatted == "### System: be kind</turn>\n### User: q</turn>\n"


def test_op1_ties_nulls_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(None, 1, "user", "b"), (None, None, "user", "z"), (None, 1, "user", "a"), (None, 1, "user", "a")], schema)
    r = chat.format_chats(chat.canonical(df, ("conv_id", "turn")), "conv_id", ["turn"]).select(chat.read_back(F.col("formatted")).alias("b")).collect()
    assert [[t.text for t in x.b] for x in r] == [["a", "a", "b", "z"]]
    assert chat.format_chats(chat.canonical(spark.createDataFrame([], schema), ("conv_id", "turn")), "conv_id", ["turn"]).count() == 0


def grams(text, n=5):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}, w


def leaks(docs, items, t=0.8):
    out = {}
    have = [(d, grams(x or "")[1]) for d, x in docs]
    for i, x in items:
        w = grams(x or "")[1]
        n = min(5, len(w))
        own = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
        for d, dw in have:
            hit = len(own & {tuple(dw[j : j + n]) for j in range(len(dw) - n + 1)}) if own else 0
            if own and hit >= t * len(own) - 1e-9:
                out[(d, i)] = (hit, len(own))
    return out


def test_op2_equals_brute_force(spark):
    d = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    b = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_shingles) for r in QUERIES["op2_decontaminate"](spark, SMALL).collect()}
    assert got == leaks(d, b) and got


def test_op2_partial_short_null_and_repeated(spark, docs):
    item = " ".join(f"w{i}" for i in range(30))
    near = item.replace("w29", "zz")
    far = " ".join(f"w{i}" if i < 22 else "q" for i in range(30))
    d = [(1, f"x {item} y"), (2, near.upper()), (3, far), (4, None), (5, ""), (6, "one two three"), (7, "two  three, FOUR"), (1, f"x {item} y"), (8, "a " * 30000 + item)]
    items = spark.createDataFrame([(1, item), (2, "Two three"), (3, None), (4, ""), (5, "...")], "item_id long, text string")
    out = decontaminate.contained(docs(*d, extra=True), items)
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_shingles) for r in out.collect()}
    assert got == leaks(d, [(r.item_id, r.text) for r in items.collect()]) and out.count() == len(got)
    assert sorted(r.doc_id for r in decontaminate.clean(docs(*d, extra=True), items).collect()) == [3, 4, 5]
    assert decontaminate.contained(docs(*d).limit(0), items).count() == 0 == decontaminate.contained(docs(*d), items.limit(0)).count()


def test_op2_clean_keeps_other_texts_of_the_same_id(spark, docs):
    item = " ".join(f"w{i}" for i in range(30))
    d = docs((None, f"x {item} y"), (None, "nothing of it here"), (None, None), (1, item), (1, "another text"), (1, "another text"), (2, item), extra=True)
    got = decontaminate.clean(d, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert got.columns == d.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == [("1", "another text")] * 2 + [("None", "None"), ("None", "nothing of it here")]


def mixed(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), [s for s in names if sizes[s]], share * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(w[s] for s in open_)
        for s in open_:
            target[s] += left * w[s] / total
        left = sum(max(0, target[s] - most * sizes[s]) for s in open_)
        for s in open_:
            target[s] = min(target[s], most * sizes[s])
        open_ = [s for s in open_ if target[s] < most * sizes[s]]
    return target


def check_mix(got):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = mixed(sizes)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1, (s, taken[s], want[s])
    return want


def test_op3_meets_the_targets(spark):
    src = {r.doc_id: (r.source, len(WORD.findall(r.text or ""))) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    first = QUERIES["op3_mix_sources"](spark, SMALL).collect()
    assert {r.doc_id: r.size for r in first} == {k: v[1] for k, v in src.items()}
    Row = spark.createDataFrame([("", 1, 1)], "source string, size long, taken long").first().__class__
    want = check_mix([Row(source=src[r.doc_id][0], size=r.size, taken=r.taken) for r in first])
    assert all(abs(r.target - want[src[r.doc_id][0]]) < 1e-6 for r in first)
    again = QUERIES["op3_mix_sources"](spark, SMALL).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_op3_hot_null_repeated_and_wordless(spark, docs):
    rows = [(i, "w " * (i % 97), "hot") for i in range(600)] + [(1000 + i, "a b c", None) for i in range(5)] + [(7, "same text", "s")] * 4 + [(8, None, "s"), (8, None, "s"), (None, "x y", "t"), (9, "", "none"), (2000, "v " * 9000, "z")]
    m = mixing.mix(docs(*rows, extra=True), block_words=64)
    got = mixing.taken(m).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, len((t or "").split())) for i, t, s in rows)
    check_mix(got)
    pieces = mixing.texts(m, docs(*rows)).collect()
    assert all(len(p.text.split()) == p.n_words for p in pieces) and sum(p.n_words for p in pieces) == sum(r.taken for r in got)
    assert mixing.taken(mixing.mix(docs(*rows).limit(0))).count() == 0
    wordless = mixing.taken(mixing.mix(docs((1, None), (2, "")))).collect()
    assert [(r.taken, r.target) for r in wordless] == [(0, 0.0)] * 2


def test_op3_schedule_is_even(spark, docs):
    """Every stretch of the mix has its sources in about their shares."""
    m = mixing.mix(docs(*[(i, "w " * 500, f"s{i % 3}") for i in range(300)]), block_words=256)
    slots = [r.source for r in m.rows.select("slot", "source").distinct().orderBy("slot").collect()]
    whole = Counter(slots)
    for a in range(0, len(slots) - 200, 100):
        part = Counter(slots[a : a + 200])
        assert all(abs(part[s] - 200 * whole[s] / len(slots)) < 12 for s in whole)


def measured(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    n, rep = len(w), len(covered)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n)


def test_op9_equals_brute_force(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = QUERIES["op9_quality_ledger"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(text)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == measured(text[r.doc_id])
        assert not (r.base_failed and r.kept)


@pytest.mark.parametrize("text", [None, "", " \t\n\x0b\x0c\r ", "a", "a b c d e f g h " * 3, "a " * 17, "   x", "é😀 " * 25, "x\n\nx\n x\nx", "a b c d e f g h i " * 2000, "|" * 50, "a\x1cb\x85c"])
def test_op9_odd_texts(docs, text):
    for r in rules.ledger(docs((1, text), (1, text), extra=True), F.col("doc_id"), F.col("text")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measured(text)[:5]


def test_op9_policies_and_ablation(spark, docs):
    good = " ".join(f"word{i}" for i in range(40))
    d = docs((1, good), (2, "few"), (3, good.upper()), (4, " ".join(f"w{i} |" for i in range(40))), (5, None), (6, "THE " * 30), extra=True)
    kept = rules.keep(d)
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [1]
    t = rules.ledger(d, F.col("doc_id"), F.col("text"))
    bits = {r.key: r.failed_bits for r in t.collect()}
    for r in rules.ablation(t, rules.WEB).collect():
        b = rules.BIT[r.rule]
        assert r.fails == sum(bool(v & b) for v in bits.values()) and r.only_this == sum(v == b for v in bits.values())
        assert r.kept_without == sum(not v & ~b for v in bits.values())
    assert rules.ledger(d.limit(0), F.col("doc_id"), F.col("text")).count() == 0
    assert rules.ablation(t.limit(0), rules.BASE).count() == 2
