"""The pipeline's stages take effect, and clean documents stay."""

from __future__ import annotations

import random

import corpus_pipeline
from tests.llm.test_llm import SCHEMA, brute_force_components, sentence


POOLS = {
    "en": "the of and to in that is was for on with as it by at this from are be or an not have".split(),
    "de": "der die und das ist nicht ein eine zu den von mit im für auf des sich dem auch es".split(),
    "fr": "le la les de des et un une du en est que qui dans pour par sur pas au ce".split(),
    "es": "el los las de y que en un una por con para se del es al lo como su no".split(),
}


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    passage = sentence(rng, 60, "p")
    texts = {k: sentence(rng, 80, "w", 5000) for k in range(120)}
    for k in range(200, 240):
        texts[k] = sentence(rng, 60, "w", 5000) + " badword " + sentence(rng, 20, "w", 5000)
    texts |= {300: texts[3] + " end", 301: sentence(rng, 40, "r", 5000) + " " + passage, 302: sentence(rng, 40, "s", 5000) + " " + passage, 303: "12 34", 304: None}
    spark.createDataFrame([(k, t, "en" if k < 300 else None, "s", len(t or ""), 0.1, 1) for k, t in texts.items()], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k >= 200)) for k in texts if k < 300], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    clean = set(range(120)) | {300, 301, 302}
    assert clean <= kept[0] and len(kept[0] & set(range(200, 240))) <= 8
    assert clean <= kept[1] and not kept[1] & {303, 304}
    assert clean - {300} <= kept[2] and 300 not in kept[2]
    assert kept[3] == kept[2] == kept[4]
    left = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/substring_duplicates").collect()}
    assert passage in left[301] and passage.split()[5] not in left[302].split()


def test_language_stage_rejects_unknown_languages(spark, tmp_path):
    rng = random.Random(3)
    texts = {k: (" ".join(rng.choice(own) for _ in range(120)), name) for k, (name, own) in enumerate(list(POOLS.items()) * 100)}
    foreign = "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью. "
    letters = "bcdfghjklmnpqrstvwxz"
    planted = {1000: foreign * 8, 1001: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(4, 10))) for _ in range(120))}
    rows = [(k, t, lang, "s", len(t), 0.1, 1) for k, (t, lang) in texts.items()] + [(k, t, None, "s", len(t), 0.1, 1) for k, t in planted.items()]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()}
    assert not kept & set(planted) and len(kept) >= 0.97 * len(texts)


def test_pipeline_with_repeated_and_null_ids_and_without_rows(spark, tmp_path):
    rng = random.Random(4)
    schema = "doc_id long, text string, lang string, source string, n_chars long, ranges string, score double"
    text = {lang: " ".join(rng.choice(own) for _ in range(90)) for lang, own in POOLS.items()}
    other = [" ".join(rng.choice(POOLS["en"]) for _ in range(90)) for _ in range(3)]
    rows = [(1, text["en"], "en"), (1, text["en"], "en"), (1, text["fr"], "fr"), (2, text["en"], "en"), (None, other[0], "en"), (None, other[0], "en"), (3, None, "en"), (4, "", None), (5, other[1], "en"), (6, "1 2 3", "en")]
    rows += [(10 + k, " ".join(rng.choice(POOLS[lang]) for _ in range(90)), lang) for k in range(30) for lang in POOLS]
    spark.createDataFrame([(k, t, lang, f"s{n}", 1, "x", 0.5) for n, (k, t, lang) in enumerate(rows)], schema).write.parquet(f"{tmp_path}/some/documents.parquet")
    spark.createDataFrame([(k, 0) for k in range(100)] + [(None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/some/labels.parquet")
    docs = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/some/documents.parquet"), "")
    kept = [(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id is None or r.doc_id < 10]
    assert sorted(kept, key=repr) == sorted([(1, text["en"], "s0"), (1, text["fr"], "s2"), (None, other[0], "s4"), (None, other[0], "s5"), (3, None, "s6"), (4, "", "s7"), (5, other[1], "s8"), (6, "1 2 3", "s9")], key=repr)
    out = corpus_pipeline.run(spark, f"{tmp_path}/some")
    assert {r.doc_id for r in out.collect()} >= {1, 5, None} and not {2, 3, 4, 6} & {r.doc_id for r in out.collect()}
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_stages_keep_what_brute_force_keeps(spark, tmp_path):
    """Near duplicates by all pairs of five-word sets; exact passages by all runs of 45 words."""
    rng = random.Random(31)
    texts = [sentence(rng, rng.randrange(60, 140), "w", 4000) for _ in range(150)]
    for k in range(60):
        w = texts[rng.randrange(150)].split()
        for at in rng.sample(range(len(w)), rng.randrange(4)):
            w[at] = f"e{k}"
        texts.append(" ".join(w))
    for _ in range(40):
        w = texts[rng.randrange(150)].split()
        at = rng.randrange(len(w) - 50)
        texts.append(sentence(rng, 70, "v", 4000) + " " + " ".join(w[at : at + 55]) + " " + sentence(rng, 70, "v", 4000))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t), 0.1, 1) for k, t in enumerate(texts)], SCHEMA)
    near = corpus_pipeline.near_duplicates(spark, docs, "")
    near.write.parquet(f"{tmp_path}/near")
    left = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/near").collect()}
    root = brute_force_components(texts, 5)
    assert left == {k: t for k, t in enumerate(texts) if root[k] == k}
    cut = {r.doc_id: r.text.split() for r in corpus_pipeline.substring_duplicates(spark, spark.read.parquet(f"{tmp_path}/near"), "").collect()}
    seen, lost = set(), 0
    for k in sorted(left):
        w = left[k].split()
        runs = [tuple(w[i : i + 45]) for i in range(len(w) - 44)]
        again = {i + j for i, run in enumerate(runs) if run in seen for j in range(45)}
        seen.update(runs)
        lost += len(again)
        # texts from 150 to 209 are near copies, of which fuzzy passages may go too
        assert len(cut.get(k, [])) <= len(w) - 0.95 * len(again) and (again or 150 <= k < 210 or cut[k] == w)
    assert lost > 1000
