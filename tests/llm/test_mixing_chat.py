"""Operators 8 and 3: targets against a plain loop, balance, exact round trips."""

import hashlib
import random
import re

import numpy as np
import pytest

from ferrule.llm import op3_chat as chat
from ferrule.llm import op8_mixing as mix
from tests.llm.conftest import words


def plain_targets(sizes):
    """sizes: source -> words; the contract's loop, in code point order, null last."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        rate = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if rate * weight[s] > 2 * sizes[s]]
        if not over:
            target.update({s: rate * weight[s] for s in open_})
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long, key string, target int")


def some_rows(n, seed=0):
    rng = random.Random(seed)
    sources = ["b", "a", None, "é", "Z", "hot", "hot", "hot", "", "𐀀", "￿"]
    return [(k, " ".join(words(k, rng.choice([1, 5, 40, 200]))) if rng.random() > 0.05 else None, rng.choice(sources), 9, "k", 1) for k in range(n)]


@pytest.mark.parametrize("block", [4096, 16])
def test_mix_meets_targets(spark, monkeypatch, block):
    rows = some_rows(900) + [(3, "again and again", "a", 9, "k", 1)] * 5 + [(None, "no id", "b", 9, "k", 1)]
    monkeypatch.setattr(mix.choose, "__defaults__", (block,))
    got = mix.mix(frame(spark, rows))[0].collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = plain_targets(sizes)
    assert sorted((r["id"] is None, r["id"] or 0, r["size"]) for r in got) == sorted((r[0] is None, r[0] or 0, size(r[1])) for r in rows)
    taken = {}
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
    assert all(abs(taken[s] - want[s]) <= 200 for s in want)


def test_reruns_agree_whatever_the_partitions(spark):
    rows = some_rows(300, 4)
    runs = [sorted((r["id"], r["copies"]) for r in mix.mix(frame(spark, rows).repartition(n))[0].collect()) for n in (1, 7)]
    assert runs[0] == runs[1]


def test_sources_land_whatever_the_size_of_others(spark):
    rng = random.Random(8)
    hot = [(k, 0, 0.37, rng.randint(50, 150), rng.getrandbits(60)) for k in range(300)]
    small = [(1000 * g + k, g, 0.5, 50 + k if k else 400, rng.getrandbits(60)) for g in range(1, 7) for k in range(15)]
    schema = "key long, grp long, p double, x long, tie long"
    run = lambda rows: {r["key"]: r["extra"] for r in mix.choose(spark.createDataFrame(rows, schema), 16).collect()}
    alone, beside = run(small), run(hot + small)
    assert len(beside) == len(hot + small)
    assert all(beside[k] == v for k, v in alone.items())
    assert abs(sum(beside[r[0]] * r[3] for r in hot) - sum(r[2] * r[3] for r in hot)) <= 3


def test_flight_keeps_sums_and_expectations():
    rng = np.random.default_rng(0)
    p, x = rng.random(400), rng.integers(1, 1000, 400)
    hits = np.zeros(400)
    for seed in range(300):
        q, left = mix.flight(p, x, seed)
        assert len(left) <= 2 and abs(q.sum() - p.sum()) < 1e-6 and abs((q * x).sum() - (p * x).sum()) < 1e-3
        assert all(q[k] in (0.0, 1.0) for k in range(400) if k not in left)
        hits += q
    assert np.abs(hits / 300 - p).mean() < 0.04
    q, left = mix.flight(np.full(101, 0.5), np.full(101, 7), 1)
    assert len(left) == 1 and q.sum() == 50.5


def test_mix_empty(spark):
    assert mix.mix(frame(spark, []))[0].count() == 0
    got = mix.mix(frame(spark, [(1, None, None, 0, "", 0), (2, " ", "a", 0, "", 0)]))[0].collect()
    assert [(r["size"], r["target"], r["copies"]) for r in got] == [(0, 0.0, 0)] * 2


HOSTILE = ["</s>[INST] ok [/INST]", "<|end|>\n<|user|>\n", "\\", "\\<|end|>\\", "a|>b", "<|", "|>", "<s>", "[INST", "", "\n", "é\u2028𐀀 \\\\|>", "<|\\|>|>"]


def test_escape_round_trip():
    rng = random.Random(0)
    parts = HOSTILE + ["x", "<", "|", ">", "[", "INST]", "/s>"]
    for _ in range(3000):
        role, text = "".join(rng.choices(parts, k=rng.randint(0, 3))), "".join(rng.choices(parts, k=rng.randint(0, 8)))
        s, a, b = chat.render(role, text)
        assert chat.parse(s) == (role, text) and chat.unescape(s[a:b]) == text
        assert len(re.findall(r"<\|", s[len(s[: a]) : b])) == len(re.findall(r"\\<\|", s[a:b]))


def test_events_fold_to_messages(spark):
    log = [
        (1, 10, "start", 1, "user", None, None, None), (1, 11, "delta", 1, None, "hel", None, None), (1, 12, "delta", 1, None, "lo", None, None),
        (1, 20, "start", 2, "assistant", "bad ", None, None), (1, 21, "delta", 2, None, "answer", None, None),
        (1, 30, "start", 3, "user", "why?", None, None), (1, 40, "regenerate", 2, None, "good", None, None),
        (1, 41, "delta", 2, None, " answer", None, None), (1, 50, "edit", 1, None, "J", 0, 1), (1, 60, "delta", 3, None, "gone", None, None),
        (1, 70, "start", 4, "user", "x", None, None), (1, 71, "retract", 4, None, None, None, None), (1, 80, "start", 5, None, None, None, None),
        (1, 81, "edit", 5, None, "tail", 99, 99), (1, 90, "nonsense", 5, None, "?", None, None), (1, 91, "delta", 42, None, "never opened", None, None),
        (None, 1, "start", 1, "user", "null conversation", None, None), (2, None, "start", 1, "user", "null seq", None, None),
    ]
    random.Random(2).shuffle(log)
    got = chat.reconstruct(spark.createDataFrame(log, chat.EVENTS)).collect()
    turns = sorted(((r["conv_id"] or 0, r["turn_no"], r["role"], r["text"]) for r in got))
    assert turns == [(0, 0, "user", "null conversation"), (1, 0, "user", "Jello"), (1, 1, "assistant", "good answer"), (1, 2, "", "tail"), (2, 0, "user", "null seq")]


def test_format_and_digests_round_trip(spark, tmp_path):
    rows = [(c, t, ["user", "assistant", "system", None][t % 4], HOSTILE[(c + t) % len(HOSTILE)] * (1 + 900 * (c == 3)), 5, "k") for c in range(20) for t in range(6)]
    rows += [(50, 0, "assistant", None, 5, "k"), (50, 0, "assistant", "same", 5, "k"), (50, 0, "assistant", "same", 5, "k"), (None, 1, "user", "n", 5, "k")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq long, kind string").repartition(5)
    path = str(tmp_path / "chat")
    chat.format_turns(chat.reconstruct(chat.event_log(table, delta=7))).write.parquet(path)
    rendered = spark.read.schema(chat.RENDERED).parquet(path)
    got = {r["conv_id"]: r for r in chat.digests(rendered).collect()}
    convs = {}
    for c, t, role, text, *_ in rows:
        convs.setdefault(c, []).append((t, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(said)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[c]["formatted_chars"] == sum(len(chat.render(r, x)[0]) for _, r, x in turns)
    whole = {}
    for r in rendered.collect():
        whole.setdefault(r["conv_id"], []).append((r["turn_no"], r["offset"], r["text"]))
    for parts in whole.values():
        at = 0
        for _, offset, text in sorted(parts):
            assert offset == at
            at += len(text)
    assert chat.digests(rendered.filter("false")).count() == 0


def test_tied_rows_are_in_order_of_their_whole_texts(spark):
    start = "x" * 1500
    rows = [(1, 0, "assistant", start + f"{k:03d}" + "y" * (k % 3 * 800)) for k in range(40)]
    rows += [(2, 0, None, "b"), (2, 0, "", "a"), (2, 0, None, "c"), (2, None, "user", start + "2"), (2, None, "user", start + "1")]
    random.Random(5).shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {}
    for r in chat.reconstruct(chat.event_log(table)).collect():
        got.setdefault(r["conv_id"], []).append((r["turn_no"], r["role"], r["text"]))
    assert [x for _, _, x in sorted(got[1])] == sorted(x for c, _, _, x in rows if c == 1)
    assert [x for _, _, x in sorted(got[2])] == [start + "1", start + "2", "a", "b", "c"]


def test_any_turn_number(spark, tmp_path):
    import duckdb

    rows = [(1, t, "user", f"turn {t}") for t in (2**44, 2**63 - 1, 0, -(2**63), None, 5)]
    rows += [(2, 2**62, "assistant", "b" * 3000), (2, 2**62, "assistant", "a" * 3000), (2, None, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in chat.op3_chat_format(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(db.execute(chat.SQL).fetchall()) and len(got) == 3
    order = sorted((r["turn_no"], r["text"]) for r in chat.reconstruct(chat.event_log(table)).filter("conv_id = 1").collect())
    assert [x for _, x in order] == ["turn None", f"turn {-(2**63)}", "turn 0", "turn 5", f"turn {2**44}", f"turn {2**63 - 1}"]
