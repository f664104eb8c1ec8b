"""The operators for training data: brute force, exact round trips, defined edge cases."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framespark.llm import bpe, packing, pieces, queries, sentences, splits

T = dt.datetime(2001, 1, 1)
UTTS = "utt_id bigint, name string, speaker string, audio_file string, tstart double, recorded_at timestamp_ntz, ingested_at timestamp_ntz, component string, split string, spk string"


def utt(i, speaker, file, at=0, tstart=None):
    return (i, f"u{i}", speaker, file, tstart, T, T + dt.timedelta(minutes=at), "clash", "clash", "clash")


def linked(rows):
    held = {}
    for r in rows:
        if r[0] is not None and (r[0] not in held or r[6] > held[r[0]][6]):
            held[r[0]] = r
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    least = {}
    for i, r in held.items():
        s = "".join(c for c in (r[2] or "").lower() if c.isalnum())
        s = None if s in ("", "unknown", "na") else s
        if s:
            least[s] = min(least.get(s, i), i)
        a, b = ("s", s) if s else ("u", i), ("f", (r[3] or "").strip().replace("./", "")) if r[3] else ("u", i)
        parent[find(a)] = find(b)
    return held, find, least


def test_splits(spark):
    r = random.Random(4)
    rows = [utt(i, r.choice([f"spk {r.randint(1, 150)}", f"SPK_{r.randint(1, 150)}", None, "unknown"]), r.choice([None, f"d/{r.randint(1, 400)}.wav", f"./d/{r.randint(1, 400)}.wav"]), tstart=r.choice([None, 1.0])) for i in range(1, 700)]
    rows += [utt(i, "Hot", f"h/{i}.wav") for i in range(1000, 1500)] + [utt(5, "moved", "m.wav", 9)] + rows[:30] + [(None,) + utt(1, "q", "q")[1:]]
    held, find, least = linked(rows)
    df = spark.createDataFrame(rows, UTTS)
    records, people = splits.grouped_splits(df), splits.membership(df)
    got = {x.utt_id: (x.component, x.split) for x in records.collect()}
    assert set(got) == set(held)
    mine, theirs = {}, {}
    for i, row in held.items():
        s = "".join(c for c in (row[2] or "").lower() if c.isalnum())
        k = ("s", s) if s not in ("", "unknown", "na") else ("f", row[3].replace("./", "")) if row[3] else ("u", i)
        mine.setdefault(find(k), set()).add(i)
    for i, (c, _) in got.items():
        theirs.setdefault(c, set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))
    of = {}
    for c, s in got.values():
        assert of.setdefault(c, s) == s
    want = {tuple(sorted((least[a], least[b]))) for a, b in itertools.combinations(least, 2) if find(("s", a)) == find(("s", b))}
    pairs = [(x.utt_a, x.utt_b) for x in splits.shared_pairs(people).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_splits_of_nothing(spark):
    none = spark.createDataFrame([], UTTS)
    assert splits.grouped_splits(none).count() == 0 and splits.shared_pairs(splits.membership(none)).count() == 0


def test_pairs_of_a_large_component(spark):
    """More speakers than one task pairs: every pair comes out once."""
    n = 3 * splits.TOGETHER + 7
    rows = [(i, 0) for i in range(n)] + [(5000, 1), (5001, 1), (6000, 2)]
    got = [(r.utt_a, r.utt_b) for r in splits.shared_pairs(spark.createDataFrame(rows, "sid bigint, component bigint")).collect()]
    assert len(got) == len(set(got)) == n * (n - 1) // 2 + 1 and (5000, 5001) in got


def test_allocation():
    r = random.Random(0)
    for _ in range(30):
        bundles = [(s, p, r.randint(1, 60)) for s, p in {(r.randint(1, 40), r.randint(0, 4)) for _ in range(30)}] + [(400, 0, 1)]
        given = splits.allocate(bundles, splits.SHARES)
        assert all(sum(given[s, p]) == n and min(given[s, p]) >= 0 for s, p, n in bundles)
        total = sum(s * n for s, _, n in bundles)
        for k, share in enumerate((0.8, 0.1, 0.1)):
            assert abs(sum(s * g[k] for (s, _), g in given.items()) - share * total) <= max(45, 0.02 * total)
    assert splits.allocate([(10, 0, 1)], splits.SHARES) == {(10, 0): [1, 0, 0]}


def test_flow_is_cheapest():
    arcs = [(0, 2, 4, 0), (2, 1, 3, 1), (2, 3, 9, 0), (3, 1, 9, 5), (0, 3, 2, 2)]
    flow = splits.min_cost_flow(4, arcs, 0, 1)
    assert flow == [4, 3, 1, 3, 2]


def speech(rate, plan, seed=0, level=1000.0, noise=10.0, offset=77.0):
    """Samples of (kind, seconds): s speech, q background, c a click in the background."""
    r = np.random.default_rng(seed)
    out = []
    for kind, seconds in plan:
        n = int(rate * seconds)
        x = r.normal(size=n) * noise
        if kind == "s":
            x = x + level * np.sin(np.arange(n) * 0.9) * (0.6 + 0.4 * np.sin(np.arange(n) / rate * 12))
        if kind == "c":
            x[n // 2] += level
        out.append(x)
    return (np.concatenate(out) + offset if out else np.zeros(0)).tolist()


SIGNALS = "signal_id bigint, item string, audio_file string, sample_rate int, dtype string, samples array<double>, text string, n int"


def signal(i, rate, x, kind="float64"):
    return (i, "i", "f", rate, kind, x, "clash", 1)


@pytest.mark.parametrize("rate", [400, 1000, 4000])
def test_pauses(spark, rate):
    plan = [("q", 0.5), ("s", 1), ("q", 0.3), ("s", 1), ("q", 0.1), ("s", 1), ("c", 0.6), ("s", 0.8), ("q", 0.4)]
    rows = [
        signal(1, rate, speech(rate, plan)), signal(2, rate, speech(rate, [("s", 5)])), signal(3, rate, speech(rate, plan[:4])), signal(4, rate, speech(rate, [("q", 5)])),
        signal(5, rate, speech(rate, plan, noise=0.0)), signal(6, rate, None), signal(7, rate, []), signal(8, None, [1.0]), signal(9, rate, [0.0] * int(rate * 4)), signal(None, rate, speech(rate, plan)),
        signal(10, rate, [None] * (rate * 5)), signal(1, rate, speech(rate, plan)),
    ]
    got = {}
    for r in pieces.found_pauses(spark.createDataFrame(rows, SIGNALS)).distinct().collect():
        got.setdefault(r.signal_id, set()).add(r.pause_no)
    assert got == {1: {0, 1, 2}, 2: {0}, 4: {0}, 5: {0, 1, 2}, None: {0, 1, 2}, 10: {0}}


def test_pieces(spark):
    rate = 500
    plan = [("s", 2.5), ("q", 0.4)] * 6 + [("s", 9)]
    x = speech(rate, plan)
    df = spark.createDataFrame([signal(1, rate, x), signal(2, rate, x[:700]), signal(3, rate, []), signal(4, rate, x[:2000]), signal(5, 16000, [0.5] * 70_000)], SIGNALS)
    got = {}
    for r in pieces.piece_samples(df).orderBy("signal_id", "piece_no").collect():
        got.setdefault(r.signal_id, []).append(r)
    assert set(got) == {1, 2, 4, 5} and len(got[2]) == len(got[4]) == 1 and len(got[5]) == 2
    for i, n, r in ((1, len(x), rate), (5, 70_000, 16000)):
        p = got[i]
        assert p[0].start == 0 and p[-1].stop == n and p[-1].boundary == "end"
        assert all(0 < q.stop - q.start <= 4 * r for q in p) and all(b.start == a.stop - int(0.2 * r) for a, b in zip(p, p[1:]))
    assert [q.boundary for q in got[1]][:4] == ["pause"] * 4 and "forced" in {q.boundary for q in got[1]}
    whole = list(got[1][0].samples)
    for q in got[1][1:]:
        whole += q.samples[int(0.2 * rate) :]
    assert whole == x
    assert pieces.pieces(df.limit(0)).count() == 0


TEXTS = [
    "", None, " ", "\n\n a", "Hello world, it's 10 o'clock; they'll've", "'s 's\n's x'llm\t'd don'tt it'S", "a" * 5000, "ab" * 3000, "<|endoftext|>", "ሴ́ é ½ Ⅷ ² 漢字 12三 😀👩‍👩‍👧", "\x1c\x1d a\x85b​c﻿", "x　y 　z\xa0 w",
    "  leading and trailing  ", "tabs\t\t\tand\r\n\r\nlines", "#!/bin/sh\nfor i in *; do echo \"$i\"; done\n", "==========", "0123456789" * 40, "'", "''", " 's", "é's",
]


def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.encode_special_tokens = True
    r = random.Random(0)
    texts = TEXTS + ["".join(r.choice(" 'sdmtlerv\n\taZ9_-é漢") for _ in range(r.randint(0, 60))) for _ in range(600)]
    sizes, ids = bpe.Encoder(bpe.vocabulary_path()).encode(texts)
    at = np.concatenate([[0], np.cumsum(sizes)])
    want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
    assert all(t.decode(w, skip_special_tokens=False) == (x or "") for w, x in zip(want[:20], texts))


def test_ids_of_tables(spark, data):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "a", ""), (0, "", "")], "doc_id bigint, text string, ids string")
    rows = bpe.encode(df).collect()
    assert len(rows) == len(TEXTS) + 2 and all(x.ids == [] for x in rows if x.doc_id in (0, 1))
    counts = {x.doc_id: x.n_tokens for x in bpe.count_tokens(df).collect()}
    assert counts == {x.doc_id: len(x.ids) for x in rows}
    assert bpe.encode(df.limit(0)).count() == 0


def test_packing_keeps_all():
    for seed in range(60):
        r = random.Random(seed)
        cap = r.choice([1, 5, 10, 37, 100])
        h = {n: r.randint(1, 9) for n in r.sample(range(1, cap + 1), r.randint(1, min(cap, 12)))}
        got: dict = {}
        for pattern, count in packing.pack_histogram(h, cap):
            assert sum(n * t for n, t in pattern) <= cap
            for n, t in pattern:
                got[n] = got.get(n, 0) + n * t * count // n
        assert got == h
    with pytest.raises(ValueError):
        packing.pack_histogram({11: 1}, 10)
    assert packing.pack_histogram({}, 10) == []


def test_containers(spark):
    r = random.Random(1)
    sizes = [r.choice([0, 1, 2, 3, 7, 30, 99, 100, 101, 250]) for _ in range(3000)] + [100_000]
    df = spark.createDataFrame([(i, n, 1) for i, n in enumerate(sizes)] + [(5, sizes[5], 1), (None, None, 1)], "doc_id bigint, n_tokens int, container int")
    rows = packing.fill_containers(df, capacity=100).collect()
    by, own = {}, {}
    for x in rows:
        by.setdefault(x.container, []).append((x.offset, x.length))
        own.setdefault(x.doc_id, []).append((x.start, x.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(p for p in parts if p[1]):
            assert o >= at
            at = o + n
        assert at <= 100
    for i, n in enumerate(sizes):
        p = sorted(own[i])
        if i != 5:
            assert sum(b for _, b in p) == n and [a for a, _ in p] == list(range(0, max(n, 1), 100))
        assert n > 100 or len(p) == (2 if i == 5 else 1)
    full = sum(sizes)
    assert len([c for c in by if sum(n for _, n in by[c])]) <= 1.02 * full / 100 + 2 and set(by) == set(range(len(by)))
    assert packing.fill_containers(df.limit(0), capacity=100).count() == 0


def test_running_sums(spark):
    r = random.Random(2)
    rows = [(i, [r.randint(1, 9) for _ in range(n)]) for i, n in enumerate((0, 1, 255, 256, 257, 1000))]
    for x in pieces.running(spark.createDataFrame(rows, "i int, l array<int>"), "l", "e").collect():
        assert x.e == np.cumsum(x.l).astype(int).tolist()


def test_blocks_of_layout():
    text = "# Head one #\n\nA para\nwrapped. Two.\n\n- item a\n- item b. More.\n1. no item\n\n1. one\n2) two\n\nTitle\n=====\n```\ncode. Not. Text.\n```\nAfter.\n---\n\n***\n~~~\nopen"
    got = [(k, text[a:b]) for k, a, b in sentences.blocks(text)]
    assert got == [("head", "Head one"), ("text", "A para\nwrapped. Two."), ("item", "item a"), ("item", "item b. More."), ("item", "no item"), ("item", "one"), ("item", "two"), ("head", "Title"), ("head", "After.")]
    assert sentences.blocks("") == [] and sentences.blocks(" \n\t\n") == [] and [k for k, *_ in sentences.blocks("a\r\nb\r\n\r\nc")] == ["text", "text"]


CORPUS = [
    "The cache is full. Dr. Ode read {n} files. It took 3.{n} sec. on the box. Wait... the counter went back! Is it done? Read wav, raw, etc. The rest waits...",
    "(It is optional.) The log read \"Disk full. Retry later.\" before it closed. Dr. Ode asked “why?” and left. No. {n} is open.",
    "磁盘已满。日志写着“请稍后。”随后停止。索引好了吗？好了！", "ระบบอ่าน{n}เฟรม อย่าเรียกใช้ซ้ำ ดัชนีเรียงแล้ว",
]


SINGLE = [
    "The cache is full.", "Dr. Ode read {n} files.", "It took 3.{n} sec. on the box.", "Wait... the counter went back!", "Is it done?", "Read wav, raw, etc.", "The rest waits...", "(It is optional.)",
    'The log read "Disk full. Retry later." before it closed.', "Dr. Ode asked “why?” and left.", "No. {n} is open.", "See sec. {n} for details.", "One of {n} failed, etc.",
]


WIDE = ["磁盘已满。", "日志写着“请稍后。”随后停止。", "索引好了吗？", "好了！", "不要重复。"]


def paragraphs():
    r = random.Random(0)
    return [" ".join(x.format(n=r.randint(1, 99)) for x in r.sample(SINGLE, r.randint(1, 5))) for _ in range(400)] + ["".join(r.sample(WIDE, r.randint(1, 4))) for _ in range(100)] + [CORPUS[3].format(n=3)] * 20


def model():
    from collections import Counter

    c = Counter()
    for t in paragraphs():
        c.update(sentences.observed(t))
    lefts = {k[1] for k in c if k[0] in ("end", "gap")}
    rights = {k[1] for k in c if k[0] in ("start", "on")} | {k[2] for k in c}
    return sentences.fit([(*k, n) for k, n in c.items()], lefts, rights)


def test_sentences():
    m = model()
    cut = lambda t: [t[a:b] for a, b in sentences.sentences_of(t, m)]
    assert cut(CORPUS[0].format(n=7)) == ["The cache is full.", "Dr. Ode read 7 files.", "It took 3.7 sec. on the box.", "Wait... the counter went back!", "Is it done?", "Read wav, raw, etc.", "The rest waits..."]
    assert cut(CORPUS[1].format(n=7)) == ["(It is optional.)", 'The log read "Disk full. Retry later." before it closed.', "Dr. Ode asked “why?” and left.", "No. 7 is open."]
    assert cut(CORPUS[2]) == ["磁盘已满。", "日志写着“请稍后。”随后停止。", "索引好了吗？", "好了！"]
    assert cut(CORPUS[3].format(n=7)) == ["ระบบอ่าน7เฟรม", "อย่าเรียกใช้ซ้ำ", "ดัชนีเรียงแล้ว"]
    assert cut("no mark at all\nand on") == ["no mark at all\nand on"] and cut("") == [] and cut(" \n ") == []


def test_posteriors_by_enumeration():
    m = model()
    chain = [("dr.", "Ode"), ("...", "the"), ("?", "Yes")]
    chain = [(m.left(a), m.right(b)) for a, b in chain]
    weight = {}
    for e in itertools.product((0, 1), repeat=3):
        p = 1.0
        for i, (a, b) in enumerate(chain):
            q = m.prior(a, e[i - 1] if i else None)
            p *= (q * m.odds(a, b)) if e[i] else 1 - q
        weight[e] = p
    total = sum(weight.values())
    want = [sum(v for e, v in weight.items() if e[i]) / total for i in range(3)]
    assert np.allclose(m.posteriors(chain), want)


SCRIPTS = {
    "khmer": "ប្រព័ន្ធដំណើរការហើយ។ សូមកុំហៅម្តងទៀត។ ឯកសារត្រូវបានអាន។",
    "burmese": "စနစ်အလုပ်လုပ်သည်။ ထပ်မခေါ်ပါနှင့်။ ဖိုင်ကိုဖတ်ပြီးပြီ။",
    "tibetan": "མ་ལག་འཁོར་བཞིན་འདུག། ཡང་བསྐྱར་མ་འབོད། ཡིག་ཆ་ཀློག་ཟིན།",
    "ethiopic": "ስርዓቱ እየሰራ ነው። እንደገና አትጥራ። ፋይሉ ተነብቧል።",
    "armenian": "Համակարգը աշխատում է։ Մի կանչեք կրկին։ Ֆայլը կարդացված է։",
    "lao": "ລະບົບກຳລັງເຮັດວຽກ ຢ່າເອີ້ນຊ້ຳອີກ ໄຟລ໌ຖືກອ່ານແລ້ວ",
    "latin": "the cache is full it took 7 sec on the box the rest waits is it done read wav raw etc one of 3 failed the cache is full",
}


def test_scripts():
    m = model()
    for name, text in SCRIPTS.items():
        got = [text[a:b] for a, b in sentences.sentences_of(text, m, unmarked=True)]
        assert len(got) > 1 and "".join(got).replace(" ", "") == text.replace(" ", ""), name
        if name not in ("latin", "lao"):
            assert len(got) == 3, name


def test_blocks_without_marks():
    """Words alone: paragraphs of the corpus without their marks and capitals are cut mostly where the marks were."""
    m = model()
    bare = ["the cache is full", "it took 3 sec on the box", "wait the counter went back", "is it done", "the rest waits", "one of 9 failed"]
    r = random.Random(3)
    hit = wrong = total = 0
    for _ in range(50):
        parts = [x[0].upper() + x[1:] for x in r.choices(bare, k=6)]
        text = " ".join(parts)
        ends = {sum(len(p) + 1 for p in parts[: i + 1]) - 1 for i in range(5)}
        got = {b for _, b in sentences.sentences_of(text, m, unmarked=True)} - {len(text)}
        hit, wrong, total = hit + len(got & ends), wrong + len(got - ends), total + 5
        assert sentences.sentences_of(text, m) == [(0, len(text))]
    assert hit >= 0.8 * total and wrong <= 0.2 * total


def test_sentences_of_tables(spark):
    rows = [(1000 + i, t, True, "x") for i, t in enumerate(paragraphs())] + [(3, CORPUS[0].format(n=3), True, "x")] * 2 + [(90, None, True, ""), (91, "", True, ""), (92, "  ", None, ""), (None, "One. Two", False, ""), (93, "word " * 40_000, True, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, prose boolean, start_char string")
    t = sentences.train(df)
    got = sentences.sentences(df, t).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.start_char, r.end_char))
    assert len(by[3]) == 14 and len(set(by[3])) == 7 and 90 not in by and 91 not in by and 92 not in by and by[93] == [(0, 5 * 40_000 - 1)]
    none = df.limit(0)
    assert sentences.sentences(none, sentences.train(none)).count() == 0
    assert sentences.sentences(df, sentences.train(none), unmarked=True).count() > 0


def test_sums_on_executors_fit_the_same(spark):
    """The model of partial sums is the model fitted in memory on the same counts."""
    from collections import Counter

    texts = paragraphs()
    t = sentences.train(spark.createDataFrame([(x,) for x in texts], "text string").repartition(3)).model
    c = Counter()
    for x in texts:
        c.update(sentences.observed(x))
    m = sentences.fit([(*k, n) for k, n in c.items()], t.lefts, t.rights)
    for name in ("event", "event_after", "first", "on", "weight", "after", "last"):
        a, b = getattr(t, name), getattr(m, name)
        assert set(a) == set(b) and all(abs(a[k] - b[k]) < 1e-6 for k in a), name


def test_rarer_types_have_values_of_their_own(spark):
    """Words that are far rarer than a thousandth still count by themselves, however much else there is."""
    r = random.Random(5)
    plain = lambda n: " ".join(f"Item {r.randint(1, 99)} was read." for _ in range(n))
    texts = [plain(20) + " The qv. rule holds. It saw a zk. Item 5 is new." for _ in range(40)] + [plain(40) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    t = sentences.train(df)
    assert not {"qv.", "zk."} & t.model.lefts
    rarer = {(x.side, x.type): x.value for x in t.rarer.collect()}
    assert rarer["l", "qv."] < 0.3 and rarer["l", "zk."] > 0.9
    assert t.model.posteriors([("qv.", "Item")], {"qv.": rarer["l", "qv."]})[0] < t.model.posteriors([("qv.", "Item")])[0]
    got = {(x.doc_id, x.start_char, x.end_char) for x in sentences.sentences(df.where("doc_id < 40"), t).collect()}
    for i, x in enumerate(texts[:40]):
        a, b = x.index("The qv."), x.index("It saw")
        assert {(i, a, b - 1), (i, b, x.index(" Item 5 is"))} <= got


SQL = sorted(queries.ORACLE)


@pytest.fixture(scope="module")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for t in ("utterances", "documents", "signals"):
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SQL)
def test_matches_sql(spark, data, duck, name):
    df = queries.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    r = duck.execute(queries.ORACLE[name])
    own = [x[0] for x in r.description]
    assert sorted(own) == cols
    assert sorted(tuple(x[c] for c in cols) for x in df.collect()) == sorted(tuple(x[own.index(c)] for c in cols) for x in r.fetchall())


def test_splits_of_the_table(spark, data):
    """Every holding utterance once, near the quotas, no component and no pair of p1_found in two splits."""
    got = queries.QUERIES["p1_method"](spark, data).collect()
    n = spark.read.parquet(f"{data}/utterances.parquet").select("utt_id").distinct().count()
    assert len(got) == len({r.utt_id for r in got}) == n
    of = {}
    assert all(of.setdefault(r.component, r.split) == r.split for r in got)
    split = {r.utt_id: r.split for r in got}
    assert all(split[r.utt_a] == split[r.utt_b] for r in queries.QUERIES["p1_found"](spark, data).collect())
    assert all(abs(sum(r.split == s for r in got) / n - q) < 0.05 for s, q in splits.SHARES.items())


@pytest.mark.parametrize("name", ["p4_found", "p4_pieces", "p4_samples", "p6_ids", "p6_counts", "p7_packs", "p7_use", "p8_method", "p8_found", "p8_sentences"])
def test_queries_run(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert df.count() > 0 and df.where(F.col(df.columns[0]).isNull()).count() == 0
