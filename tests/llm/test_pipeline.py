"""The stages of corpus_pipeline on a small corpus with planted cases."""

import hashlib
import random

import corpus_pipeline
import public_tokenizers
from pileline.llm import toxicity
from tokenizers import Tokenizer


def corpus(folder, spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghijkl") for _ in range(r.randrange(2, 9))) for _ in range(4000)]
    text = lambda n: "\n".join(" ".join(r.choice(words) for _ in range(25)) for _ in range(n))
    docs = {d: text(r.randrange(2, 6)) for d in range(80)}
    toxic = set(range(80, 90))
    for d in toxic:
        docs[d] = text(2) + "\nyou idiot " + " ".join(r.choice(words) for _ in range(12))
    docs[90] = docs[3]  # an exact copy
    docs[91] = docs[4] + "\n" + text(1)  # shares all lines of 4, and has one of its own
    docs[92] = docs[5].split("\n")[0]  # only lines of another document
    flat = text(6).replace("\n", " ")
    docs[93], docs[94] = flat + " " + " ".join(r.choice(words) for _ in range(2)), flat.replace("\n", " ")
    docs[95], docs[96] = "", None
    rows = [(d, t, "en", f"s{d % 3}", len(t or "")) for d, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d in toxic)) for d in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, toxic


def test_stages(spark, tmp_path):
    docs, toxic = corpus(str(tmp_path), spark)
    rows, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = rows.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, rows, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = rows.collect()
        if name != "bpe_round_trip":
            assert rows.columns == columns
    ids = {n: [x.doc_id for x in v] for n, v in kept.items()}
    assert set(ids["toxicity"]) == set(docs) - toxic
    after = {x.doc_id: x.text for x in kept["line_dedup"]}
    assert 90 not in after and 92 not in after and after[91] == docs[91].split("\n")[-1] and after[3] == docs[3]
    assert all(x.n_chars == len(x.text) for x in kept["line_dedup"] if x.text is not None)
    clean = set(range(80)) | {91}
    assert clean <= set(ids["simhash_near_dedup"]) and len({93, 94} & set(ids["simhash_near_dedup"])) == 1 and len({95, 96} & set(ids["simhash_near_dedup"])) == 1
    assert set(ids["source_mixing"]) <= set(ids["simhash_near_dedup"])
    texts = {x.doc_id: x.text or "" for x in kept["source_mixing"]}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for x in kept["bpe_round_trip"]:
        want = library.encode(texts[x.doc_id], add_special_tokens=False).ids
        assert (x.n_tokens, x.ids_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
    assert sorted(ids["bpe_round_trip"]) == sorted(ids["source_mixing"])
    assert toxicity.KINDS
