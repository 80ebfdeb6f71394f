import random
import re
from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline
from nodalis.llm import mixing, quality
from tests.llm.test_pii import brute as brute_spans
from tests.llm.test_simhash import brute_components, brute_fingerprint

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tables(spark, folder):
    draw = random.Random(8)
    vocabulary = [f"w{'abcdefgh'[i % 8]}{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(160):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(20, 60))]
        if i % 9 == 0 and docs:
            text = docs[-1][1]
        elif i % 4 == 0:
            text = " ".join(w.upper() + "!!" for w in words)
        else:
            text = " ".join(words) + (f" mail a{i}@b.example.com end." if i % 5 == 0 else ".")
        docs.append((i, text, "en", draw.choice(["s1", "s1", "s2", None]), len(text)))
        labels.append((i, int(not text.isupper()), 0))
    docs += [docs[7], (500, None, None, "s2", None), (None, " ".join(vocabulary[3:300:9]) + ".", "en", "s1", 10)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages_against_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    docs = tables(spark, folder)
    read = spark.read.parquet(f"{folder}/documents.parquet")
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, read, folder)
        if len(outs) < 4:
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        frame.write.parquet(f"{folder}/{len(outs)}")
        read = spark.read.parquet(f"{folder}/{len(outs)}")
        outs.append([tuple(r) for r in read.collect()])

    good = {r.doc_id for r in quality.classify(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect() if r.predicted}
    key = str
    assert sorted(outs[0], key=key) == sorted((d for d in docs if d[0] in good), key=key)
    assert {d[0] for d in docs if d[1] and d[0] is not None and not d[1].isupper()} <= good
    assert not {d[0] for d in docs if d[1] and d[1].isupper()} & good

    with_id = {d[0]: d for d in outs[0] if d[0] is not None}
    classes = brute_components({i: brute_fingerprint(d[1]) for i, d in with_id.items()})
    assert sorted((d for d in outs[1] if d[0] is not None), key=key) == sorted((with_id[i] for i in set(classes.values())), key=key)
    assert sum(d[0] is None for d in outs[1]) == 1

    before = {d[0]: d for d in outs[1]}
    assert {d[0] for d in outs[2]} == set(before)
    for i, text, _, _, n in outs[2]:
        old = before[i][1]
        want = old
        for kind, start, end in sorted(brute_spans(old or ""), key=lambda s: -s[1]):
            want = want[:start] + f"[{kind.upper()}]" + want[end:]
        assert text == want and n == (None if want is None else len(want))

    mixed = mixing.mix(spark.read.parquet(f"{folder}/2")).collect()
    copies = {r.doc_id: r.copies for r in mixed}
    assert Counter(d[0] for d in outs[3]) == Counter({i: c for i, c in copies.items() if c})
    sizes = {d[0]: len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")) for d in outs[2]}
    assert abs(sum(sizes[d[0]] for d in outs[3]) - 1.5 * sum(sizes.values())) < 3 * 70

    texts = {d[0]: d[1] or "" for d in outs[3]}
    assert len(outs[4]) == len(outs[3])
    for i, ids, n, _, same in outs[4]:
        assert ids == LIBRARY.encode(texts[i]) and n == len(ids) and same

    assert sorted((tuple(r) for r in corpus_pipeline.run(spark, folder).collect()), key=key) == sorted(outs[4], key=key)
