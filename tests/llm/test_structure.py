"""Packing, conversation repair and the filter audit against brute force and on odd rows."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
from tidewater.llm import filteraudit, packing, queries, repair

SF = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("byte_bpe_50k.json")


def rows(df):
    return [r.asDict() for r in df.collect()]


# ----------------------------------------------------------------- 11
@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(MODEL)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def check_packing(pieces, examples, max_tokens, max_segments, max_loss):
    """Every id of every example in one piece, every sequence within its limits; returns padding and ids.

    ``examples``: id -> list of (ids, silent ids) that share it.
    """
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_seq[p["sequence_id"]].append(p)
        by_doc[p["doc_id"]].append(p)
    assert set(by_doc) == set(examples)
    for d, ps in by_doc.items():
        want = sorted(examples[d])
        if len(want) == 1:
            (ids, silent), at = want[0], 0
            for p in sorted(ps, key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(ids)
                assert bytes(p["ids"]) == np.array(ids[at:at + p["length"]], "<u4").tobytes()
                at += p["length"]
                assert p["loss_tokens"] == p["length"] - max(0, min(at, silent) - p["start"])
            assert at == len(ids)
        else:
            assert sum(p["length"] for p in ps) == sum(len(i) for i, _ in want)
    padding = total = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= max_tokens and len(ps) <= max_segments and sum(p["loss_tokens"] for p in ps) <= max_loss
        padding += max_tokens - at if at & (at - 1) else 0
        total += at
    return padding, total


def test_packing_holds_every_id_once(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: [(library(r.text) + [1], 0)] for r in docs.collect()}
    padding, total = check_packing(rows(packing.pack(docs, MODEL)), want, 2048, 128, 2048)
    assert padding == 0 and total == sum(len(i) for x in want.values() for i, _ in x)
    got = rows(E.queries()["op11_packing"](spark, SF))
    for p in got:
        ids = want[p["doc_id"]][0][0][p["start"]:p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("limits", [(256, 3, 256), (256, 128, 40), (300, 4, 100), (16, 1, 5)])
def test_packing_under_three_limits(spark, library, prose, limits):
    rng = random.Random(1)
    ex = [(i, prose(i, rng.randrange(0, 40)), prose(1000 + i, rng.choice([0, 1, 5, 60, 200]))) for i in range(300)]
    df = spark.createDataFrame(ex, "doc_id long, prompt string, text string").repartition(3)
    want = {i: [(library(p) + library(t) + [1], len(library(p)))] for i, p, t in ex}
    t, s, loss = limits
    padding, total = check_packing(rows(packing.pack(df, MODEL, prompt="prompt", max_tokens=t, max_segments=s, max_loss=loss)), want, t, s, loss)
    assert padding == 0 and total == sum(len(i) for x in want.values() for i, _ in x)


def test_dot_product_prefers_what_fills_the_roomiest_limit():
    """With all of the loss budget left, the piece that bears the most loss goes in first; ties take the first slot."""
    p = packing.Packer(8, 4, 4)
    for name, n, silent in (("a", 4, 4), ("b", 4, 0), ("c", 4, 0)):
        p._put(packing.Piece(name, 0, bytes(4 * n), silent, n))
    assert [x.example for x in p._sequence()] == ["b", "a"]
    assert [x.example for x in p.waiting if x] == ["c"]


def test_packing_odd_rows(spark, docs, library):
    out = rows(packing.pack(docs, MODEL))
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append((library(r.text) + [1], 0))
    assert check_packing(out, want, 2048, 128, 2048)[0] == 0
    assert rows(packing.pack(docs.limit(0), MODEL)) == []


@pytest.mark.parametrize("seed", range(3))
def test_ids_by_unit_are_the_librarys(library, seed, monkeypatch):
    """White space of all kinds, special strings, odd characters and texts cut into chunks."""
    monkeypatch.setattr(packing, "CHUNK", 50)
    reader, rng = packing.Ids(open(MODEL, encoding="utf-8").read()), random.Random(seed)
    parts = [" ", "  ", "\n", "\n\n ", "\t", "\x0b", "\x0c", "\r\n", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "​", "　", "﻿", "a", "don't", "I'll",
             "'s", "12", "٣", "é", "́", "漢字", "🙂", "<|endoftext|>", "<|endof", "text|>", "...", "!!", "_", "\x00", "word", "The", "­"]
    assert reader.by_unit
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(60)))
        assert np.frombuffer(reader.of(text), "<u4").tolist() == library(text), repr(text)


def test_a_very_long_word_and_a_very_long_text(library, prose):
    reader = packing.Ids(open(MODEL, encoding="utf-8").read())
    for text in ("x" * 300_000, prose(1, 400_000), " " * 100_000):
        assert np.frombuffer(reader.of(text), "<u4").tolist() == library(text)


# ----------------------------------------------------------------- 12
SPACE = " \t\n\x0b\x0c\r"
ROLE = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}


def faults(conv):
    """First fault of each row of one ordered conversation."""
    seen, out = set(), []
    for role, text in conv:
        last = text.rstrip(SPACE)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
        seen.add((role, text))
    return out


def regular(initials):
    body = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (len(body) > 0 and body == "ua" * (len(body) // 2))


def brute(conv, extra=2):
    """(cost, audit, repaired) by trying every edit of every row and every role of up to ``extra`` inserts per place."""
    bad = faults(conv)
    gaps = [i for k in range(extra + 1) for i in itertools.product("ua", repeat=k)]
    found = []

    def go(k, cost, audit, roles, out):
        if found and cost > found[0][0] or len(roles) > 2 * len(conv) + 2:
            return
        for g in gaps:
            c, a, r = cost + 5 * len(g), audit + "I" * len(g), roles + "".join(g)
            o = out + [(ROLE[x], "") for x in g]
            if k == len(conv):
                if regular(r):
                    found.append((c, a, o))
                    found.sort(key=lambda f: f[:2])
                continue
            role, text = conv[k]
            go(k + 1, c + 2, a + "D", r, o)
            if bad[k] not in ("blank", "duplicate"):
                more = 5 if bad[k] == "truncated" else 0
                go(k + 1, c + more, a + "K", r + (role[:1] or "?"), o + [(role, text)])
                for new in "ua":
                    go(k + 1, c + 1 + more, a + "R", r + new, o + [(ROLE[new], text)])

    go(0, 0, "", "", [])
    return found[0]


def expected(conv, turns):
    bad, initials = faults(conv), [r[:1] for r, _ in conv]
    cost, audit, out = brute(conv)
    known = {t for t in turns if t is not None}
    return {"gaps": max(known) - min(known) + 1 - len(known) if known else 0, "blank": bad.count("blank"), "duplicate": bad.count("duplicate"),
            "truncated": bad.count("truncated"), "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()}


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(3)
    roles, texts = ["system", "user", "user", "assistant", "assistant", "tool", ""], ["a.", "b?", "c! \n", "cut", "", " \t", "d."]
    return {i: [(rng.choice(roles), rng.choice(texts)) for _ in range(rng.randrange(0, 5))] for i in range(120)}


def test_repair_is_the_cheapest(spark, conversations):
    """All counts, costs, audits and repaired rows against every possible edit."""
    data = [(c, t * (1 + c % 2), r, x) for c, rs in conversations.items() for t, (r, x) in enumerate(rs)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(5)
    ids = spark.createDataFrame([(c,) for c in conversations], "conv_id long")
    got = {r.pop("conv_id"): r for r in rows(repair.summaries(repair.repair(df, ids)))}
    assert got == {c: expected(rs, [t * (1 + c % 2) for t in range(len(rs))]) for c, rs in conversations.items()}


def test_query_matches_brute_force(spark):
    damaged = defaultdict(list)
    raw = sorted((r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect())
    for c, t, role, text in raw:
        hit = zlib.crc32(f"{c}:{t}".encode()) % 20
        text = "" if hit == 1 else text.translate({ord(x): None for x in ".!?"}) if hit == 2 else text
        damaged[c] += [(t, "user" if hit == 4 else role, text)] * {0: 0, 3: 2}.get(hit, 1)
    got = {r.pop("conv_id"): r for r in rows(E.queries()["op12_conversation_repair"](spark, SF))}
    assert set(got) == {r[0] for r in raw}
    small = {c: damaged[c] for c in got if len(damaged[c]) <= 6}
    assert len(small) > 10
    for c, rs in small.items():
        assert got[c] == expected([r[1:] for r in rs], [r[0] for r in rs]), c


def plain(symbols):
    """Row by row, without rules: every state's cheapest audit by comparing whole strings."""
    live = {0: (0, "")}
    for s in symbols:
        live = {p: (c, repair.flat(r)) for p, (c, r) in repair.product(live, repair.terminal(s)).items()}
    end = repair.product(live, repair.INSERTS)
    return min((c, repair.flat(r)) for p, (c, r) in end.items() if p in repair.ENDS)


def test_rules_blocks_and_settling_change_nothing(spark, monkeypatch):
    rng = random.Random(5)
    strings = ["".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(1, 200))) for _ in range(40)]
    strings += ["x" * 100, "ua" * 80, "u" * 90, "s" * 50 + "ua" * 30, "U" * 60, "a" * 41]
    g = repair.learn(spark.createDataFrame([(s, 1) for s in strings], "symbols string, n long"))
    assert g.rules and max(len(g.compress(s)) for s in strings) < 200
    for settle in (1, 3, 256):
        monkeypatch.setattr(repair, "SETTLE", settle)
        for s in strings:
            fold = repair.Fold()
            for i in range(0, len(s), 7):
                fold.add(g, s[i:i + 7])
            assert fold.best() == plain(s), s


def test_a_conversation_over_many_tasks(spark, monkeypatch):
    """Blocks and partitions cut a long conversation, also between equal rows and rows of one turn."""
    rng = random.Random(9)
    long = [(t // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["yes.", "no.", f"{t}.", f"{t}", ""])) for t in range(3000)]
    long += [(None, "user", "same.")] * 5 + [(7, "user", "same.")] * 300
    df = spark.createDataFrame([(1, *r) for r in long] + [(2, 0, "user", "q?"), (2, 1, "assistant", "a.")],
                               "conv_id long, turn long, role string, text string").repartition(6)
    order = sorted(long, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    bad = faults([r[1:] for r in order])
    symbols = "".join("x" if f in ("blank", "duplicate") else r[1][0].upper() if f else r[1][0] for f, r in zip(bad, order))
    for block in (4096, 64):
        monkeypatch.setattr(repair, "BLOCK", block)
        out = {r["conv_id"]: r for r in rows(repair.summaries(repair.repair(df)))}
        r = out[1]
        assert (r["cost"], r["audit"]) == plain(symbols)
        assert [r["blank"], r["duplicate"], r["truncated"]] == [bad.count(x) for x in ("blank", "duplicate", "truncated")]
        initials = [x[1][0] for x in order]
        assert r["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        assert r["gaps"] == 0 and out[2]["audit"] == "KK"
    roles = "".join(r["role"][0] for r in rows(repair.repair(df).where("conv_id = 1 and position is not null").orderBy("position")))
    assert regular(roles)


def test_repair_odd_rows(spark):
    data = [(None, 1, "user", "hi."), (None, None, None, None), (3, None, "assistant", "x" * 200_000 + "."), (3, None, "user", "y?"), (4, 5, "user", None)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as kind", "'z' as audit", "2 as n", "3 as conv")
    ids = spark.createDataFrame([(None,), (3,), (4,), (9,)], "conv_id long")
    got = {r["conv_id"]: r for r in rows(repair.summaries(repair.repair(df, ids)))}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[9] == {"conv_id": 9, **dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], 0), "audit": "", "repaired_sha256": empty}
    assert got[None]["blank"] == 1 and got[None]["audit"] == "DD" and got[None]["gaps"] == 0
    assert got[3]["audit"] == "RR" and got[4]["audit"] == "D"
    assert rows(repair.summaries(repair.repair(df.limit(0)))) == []


# ----------------------------------------------------------------- 13
def audited(docs, labels):
    first, info = {}, defaultdict(lambda: [False, False])
    for d, q, t in labels:
        if d is not None:
            info[d] = [info[d][0] or q == 1, info[d][1] or t == 1]
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    cells = []
    for d, text, lang in docs:
        text = text or ""
        words = [w for w in "".join(" " if c in SPACE else c for c in text).split(" ") if w]
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
             "D": any(c in "#$%&*|" for c in text), "E": d is not None and first[text] < d}
        cells.append((lang or "", {k for k, v in f.items() if v}, *(info[d] if d is not None else [False, False])))
    out = {}
    for part in {c[0] for c in cells}:
        mine = [c[1:] for c in cells if c[0] == part]
        total = defaultdict(int)
        for order in itertools.permutations("ABCDE"):
            alive = list(mine)
            gone = []
            for k, x in enumerate(order):
                here, alive2 = [c for c in alive if x in c[0]], [c for c in alive if x not in c[0]]
                out[part, "".join(order), k + 1] = [len(alive2), len(here), sum(x in c[0] for c in gone), sum(c[0] == {x} for c in mine),
                                                    sum(c[1] for c in here), sum(c[2] for c in here)]
                total[x] += len(here)
                gone, alive = gone + here, alive2
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return out


def test_audit_matches_every_order_run_one_by_one(spark, docs):
    base = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(
        [(20, "LOUD " * 300, "en"), (21, "LOUD " * 300, "en"), (22, "LOUD " * 300, None), (19, "LOUD " * 300, "xx"), (19, "LOUD " * 300, "xx"),
         (None, "LOUD " * 300, "en"), (23, "a|b " * 5, "en"), (24, None, ""), (25, " ".join(map(str, range(500))), "en")], "doc_id long, text string, lang string"))
    labels = [(1, 1, 0), (2, 1, 1), (20, 0, 1), (20, 1, None), (21, None, None), (None, 1, 1), (8, 1, 1), (999, 1, 1)]
    got = filteraudit.audit(base.withColumn("mask", F.lit("x")).withColumn("n", F.lit(7)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = audited([tuple(r) for r in base.collect()], labels)
    cols = [*filteraudit.COUNTS, "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in cols] for r in rows(got)} == want
    assert got.schema["step"].dataType.simpleString() == "int" and {got.schema[c].dataType.simpleString() for c in cols} == {"bigint"}


def test_audit_of_nothing(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rows(filteraudit.audit(docs.limit(0), labels)) == []
    assert len(rows(filteraudit.audit(docs.limit(1), labels))) == 600


def test_cells_stay_few(spark):
    """However many copies, a text is at most one row per part, filters and labels before its smallest id is looked up."""
    docs = spark.range(20000).selectExpr("id as doc_id", "'same text' as text", "if(id % 2 = 0, 'en', 'de') as lang")
    cells = rows(filteraudit.mask_cells(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert {(c["part"], c["mask"]): c["n"] for c in cells} == {("en", 1): 1, ("en", 17): 9999, ("de", 17): 10000}


def test_queries_have_sql():
    assert {"op12_conversation_repair", "op13_filter_audit"} <= set(queries.SQL)
