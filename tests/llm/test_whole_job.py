"""Cases in which an operator once did less than its whole job."""
import itertools
import random

from pyspark.sql import functions as F

from taskgrid.llm import common, decontam, licenses, quality_rules, sentencepieces
from taskgrid.llm.token_counts import default_model

SF = "/root/testdata/sf0.001"


def words(seed, n=80):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_near_dedup_goes_by_row(spark):
    import corpus_pipeline as p
    common.ship(spark)
    a, b, c, d, e = (words(k) for k in range(5))
    rows = [(None, a), (None, b), (None, a), (3, c), (7, c), (7, d), (7, d), (None, e), (9, e), (10, None)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    out = p.near_dedup(spark, df, SF)
    assert out.columns == p.COLUMNS
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(
        [(None, a), (None, b), (3, c), (7, d), (9, e), (10, None)], key=str)


def test_all_n_best_come_back_as_ids(spark):
    m = sentencepieces.lattice(default_model())

    def score(ids):
        total, k = 0.0, 0
        while k < len(ids):
            if m.sp.is_byte(ids[k]):  # the bytes of one character count once
                lead = m.raw[ids[k]][0]
                k += 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                total += m.unknown
            else:
                total, k = total + m.score[m.sp.id_to_piece(ids[k])], k + 1
        return total
    common.ship(spark)
    texts = ["then the", "on  in", "é 日 a", "", None, "a\nb", "than that nation", "🙂 thin", " lead", "x" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = sentencepieces.decode(sentencepieces.encode(df, n_best=5, check=True), "pieces.ids").select(
        "*", F.posexplode_outer("pieces.others").alias("k", "other"))
    out = sentencepieces.decode(out, "other", "other_text").collect()
    seen = {}
    for r in out:
        assert r.decoded == (r.text or "") and r.pieces.round_trip
        assert len(r.pieces.others) == len(r.pieces.scores) - 1
        all_ids = [r.pieces.ids, *r.pieces.others]
        assert len(set(map(tuple, all_ids))) == len(all_ids)
        assert [score(x) for x in all_ids] == r.pieces.scores
        if r.other is not None:
            assert r.other_text == (r.text or "")
            seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen[0] == 4 and seen[6] == 4
    for w in ["▁then", "▁nation", "tion"]:  # every cutting of a word, best first
        every = set()
        for keep in itertools.product([0, 1], repeat=len(w) - 1):
            cuts = [0, *[i + 1 for i, k in enumerate(keep) if k], len(w)]
            ps = [w[a:b] for a, b in zip(cuts, cuts[1:])]
            if all(x in m.ids for x in ps):
                every.add(tuple(m.ids[x] for x in ps))
        got = [tuple(x.tolist()) for _, x in m.n_best_ids(w, len(every) + 1)]
        assert len(got) == len(every) and set(got) == every


def test_license_words_not_split_by_white_space(spark):
    rows = [(1, "Licensed\u00a0under\u00a0CC\u00a0BY\u00a04.0."), (2, "x\nLicensed_under/CC-BY-4.0"), (3, "no notice")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license, r.start, r.dice) for r in licenses.scan(df, licenses.templates(spark)).collect()}
    assert got == {(1, "CC-BY-4.0", 1, 1.0), (2, "CC-BY-4.0", 2, 1.0)}


def test_scores_do_not_depend_on_blocks(spark, monkeypatch):
    common.ship(spark)
    rng = random.Random(5)
    items = [(k, "all items say " + words(100 + k, rng.randint(30, 60)) + ". " + words(200 + k, 6)) for k in range(30)]
    items += [(40, None), (41, " "), (42, "common common w1 w2 w3. w4 w5 w6 w7 w8"), items[3]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(k, f"{words(300 + k)} {t} {words(400 + k)}") for k, t in items if t]
    rows += [(60 + k, t[len("all items say "):]) for k, t in items[:30]]  # held in part: scores follow the frequencies
    rows += [(50, f"{items[0][1]} {items[7][1]}"), (51, None), (52, words(9)), rows[0]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, matches string")

    def found():
        out = decontam.with_matches(df, bench)
        assert out.columns == ["doc_id", "text", "matches"]
        return sorted((r.doc_id, sorted((m.item_id, round(m.score, 9), m.question_overlap, m.answer_overlap)
                                        for m in r.matches)) for r in out.collect())
    want = found()
    assert len(want) == len(rows) and sum(bool(m) for _, m in want) >= 32
    for name, value in (("ITEMS", 7), ("ITEM_BYTES", 1500)):
        with monkeypatch.context() as m:
            m.setattr(decontam, name, value)
            assert found() == want


def test_fit_fetches_one_row_of_an_id(spark, monkeypatch):
    common.ship(spark)
    docs = spark.createDataFrame([(1, words(k)) for k in range(50)] + [(2, "a a a"), (3, words(60))],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality long")
    seen = []
    monkeypatch.setattr(quality_rules, "learn", lambda x, bad, precision: seen.append((len(x), int(bad.sum()))) or [])
    quality_rules.fit(docs, labels)
    assert seen == [(3, 1)]
