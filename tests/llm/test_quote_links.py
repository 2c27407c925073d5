import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from tickloom.llm import quote_links

SCHEMA = "conv_id long, turn long, role string, text string, pos string, extra int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


THREAD = [
    (1, 0, "user", "How do I sort a list? I tried the manual."),
    (1, 1, "assistant", "Use sorted. It returns a new list."),
    (1, 2, "user", "> Use sorted. It returns\n> a new list.\nThat copies it. Can it be in place?"),
    (1, 3, "assistant", "On Monday, Ann wrote:\n> > Use SORTED.\n> That copies it.\n> Can it be in place?\nYes, call sort."),
    (1, 4, "user", "> I tried the manual.\nWhich page of it?"),
    (1, 5, "assistant", "Page two."),
    (1, 6, "user", "> Nothing that was ever said.\nHm."),
]


def test_nested_quotes_link_and_order(spark):
    rows = {r.turn: r for r in quote_links.thread(frame(spark, THREAD)).collect()}
    assert [rows[t].reply_to for t in range(7)] == [None, 0, 1, 2, 0, 4, 5]
    assert [rows[t].depth for t in range(7)] == [0, 1, 2, 3, 1, 2, 3]
    assert [(rows[t].n_quotes, rows[t].n_linked) for t in range(7)] == [(0, 0), (0, 0), (1, 1), (2, 2), (1, 1), (0, 0), (1, 0)]
    assert [rows[t].body for t in (2, 3, 4)] == ["That copies it. Can it be in place?", "Yes, call sort.", "Which page of it?"]
    order = {t: rows[t].reply_order for t in rows}
    assert sorted(order.values()) == list(range(1, 8)) and all(order[r.reply_to] < order[t] for t, r in rows.items() if r.reply_to is not None)


def test_deep_branches(spark):
    talk = [(9, 0, "u", "Root sentence zero.")] + [(9, i, "u", f"> {'Root' if i == 1 else 'Next'} sentence {'zero' if i == 1 else max(i - 2, 0)}.\nNext sentence {i}.") for i in range(1, 12)]
    talk[2] = (9, 2, "u", "> Root sentence zero.\nNext sentence 2.")
    parent = {i: (0 if i <= 2 else i - 2) for i in range(1, 12)}
    rows = {r.turn: r for r in quote_links.thread(frame(spark, talk)).collect()}
    depth = {0: 0}
    for i in range(1, 12):
        depth[i] = depth[parent[i]] + 1
    assert {t: r.depth for t, r in rows.items()} == depth
    assert {t: r.reply_to for t, r in rows.items() if t} == parent


def test_awkward_rows(spark):
    odd = [(None, None, None, None), (None, None, None, None), (2, 1, "u", ""), (2, 1, "u", ""), (2, None, "u", ">"), (2, 2, None, ">>> x\r\n>\r\ny\r\n"), (3, 1, "u", "a. " * 50_000)]
    rows = quote_links.thread(frame(spark, odd)).collect()
    assert len(rows) == len(odd)
    assert sorted(r.reply_order for r in rows if r.conv_id == 2) == [1, 2, 3, 4]
    assert [r.body for r in rows if r.turn == 2] == ["y"]
    assert quote_links.thread(frame(spark, odd).limit(0)).count() == 0


def test_plain_conversations_keep_their_order(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = quote_links.thread(table).collect()
    assert len(rows) == table.count() and all(r.depth == r.reply_order - 1 for r in rows if not r.n_linked)


def test_lines_and_sentences_without_spaces(spark):
    talk = [
        (1, 0, "u", "Buy milk\nCall Bob\nPay rent"), (1, 1, "a", "Noted."), (1, 2, "u", "Thanks."), (1, 3, "a", "> Call Bob\nDone."),
        (2, 0, "u", "今日は雨です。傘を持って行きます。駅で会いましょう！"), (2, 1, "a", "はい。"), (2, 2, "u", "どうも。"), (2, 3, "a", "> 傘を持って行きます。\n私も。"),
        (3, 0, "u", "Title of it\nCall Bob. Then pay\nthe rent"), (3, 1, "a", "Sure."), (3, 2, "u", "Fine."), (3, 3, "a", "> Call Bob.\nDone."),
        (4, 0, "u", "I agree with you."), (4, 1, "a", "So do I with\nyou."), (4, 2, "u", "Fine."), (4, 3, "a", "> I agree with\n> you.\nGood."),
    ]
    rows = {(r.conv_id, r.turn): r for r in quote_links.thread(frame(spark, talk)).collect()}
    assert [(rows[c, 3].n_linked, rows[c, 3].reply_to, rows[c, 3].depth) for c in (1, 2, 3, 4)] == [(1, 0, 1)] * 4
