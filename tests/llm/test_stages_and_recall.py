"""The pipeline's stages on awkward rows against plain programs, and the recall of personal data on rows that the field never saw."""

import random
import re

import corpus_pipeline
import public_tokenizers
import tokenizers

from tests.conftest import DATA
from tests.llm.fixtures import documents, empty, rows, words
from tests.llm.test_tokens_and_repeats import shingle_set
from weftline.llm import pii_crf, toxicity


def key(values):
    return sorted(tuple((v is None, str(v)) for v in r) for r in values)


def test_stages_against_plain_programs(spark):
    item = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").limit(2).collect()]
    extra = [(None, f"{words(31, 30)} {item[0]} {words(32, 30)}"), (950, item[1]), (950, item[1]), (951, "you are an idiot and a stupid worthless idiot you scum " * 4), (None, "mail a.b@c.de now")]
    given = rows() + [(*r, *rows()[0][2:]) for r in extra]
    docs = spark.createDataFrame(given, documents(spark).schema)

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    own = docs.select("doc_id", "text").where(~toxicity.held_out(3, 1))
    model = toxicity.fit_toxicity(own, labels.where(~toxicity.held_out(3, 1)))
    kept = corpus_pipeline.toxicity(spark, docs, DATA)
    assert kept.columns == docs.columns
    assert key(kept.collect()) == key([r for r in given if model.score([r[1]])[0] < 0.7])

    items = [s for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if (s := shingle_set(r.text))]
    clean = corpus_pipeline.decontamination(spark, docs, DATA)
    assert key(clean.collect()) == key([r for r in given if not any(100 * len(s & shingle_set(r[1])) >= 80 * len(s) for s in items)])
    assert clean.count() < len(given)

    masked = corpus_pipeline.personal_data(spark, docs, DATA)
    assert masked.columns == docs.columns
    texts = [t for _, t, *_ in masked.collect()]
    assert len(texts) == len(given)
    assert "mail <email> now" in texts

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.tokens(spark, docs, DATA).collect()}
    assert ids == {(r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in given}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), DATA).count() == 0


#: Rows in words and forms of their own; # is any digit. Fixed values.
HELD = """
please forward this to <email>k.larson (at) webmail (dot) net</email> soon
our desk <email>help.desk [at] firm [dot] org</email> opens at nine
the owner <email>nina[at]garden.example.org</email> replied
logs show <ip>###[.]##[.]#[.]##</ip> twice
we blocked <ip>##(.)##(.)##(.)##</ip> yesterday
her number <phone>(###) ###-####</phone> rings
text <phone>###-###-####</phone> if late
the office <phone>###.###.####</phone> closed
they billed <card>####.####.####.####</card> twice
old <card>####/####/####/####</card> expired
"""
BASE = {"email": "tom##@mail.example.org", "ip": "1#.2#.3.4#", "phone": "+1 (415) 555-26##"}


def test_recall_of_every_kind():
    rnd = random.Random(11)
    field = pii_crf.trained_field()
    want, found, wrong, clean = {k: 0 for k in pii_crf.KINDS}, {k: 0 for k in pii_crf.KINDS}, 0, 0
    for _ in range(60):
        for row in HELD.strip().split("\n") + [f"filler {words(rnd.randrange(10**6), 3)} <{k}>{form}</{k}> {words(rnd.randrange(10**6), 3)}" for k, form in BASE.items()] + ["on ## June #### they met ### people", f"{words(rnd.randrange(10**6), 8)} at ##:##"]:
            row = re.sub("#", lambda _: rnd.choice("123456789"), row)
            kind = re.search(r"<(\w+)>", row)
            text = re.sub(r"</?\w+>", "", row)
            base = pii_crf.pattern_spans(text)
            added = pii_crf.added_spans(field, *pii_crf.text_bytes(__import__("pyarrow").array([text]))).get(0, [])
            spans = {(pii_crf.KINDS[k], text[a:b]) for k, a, b in [*base, *added]}
            if kind is None:
                clean += 1
                wrong += bool(spans)
                continue
            span = re.search(r"<\w+>(.*)</", row)[1]
            want[kind[1]] += 1
            found[kind[1]] += (kind[1], span) in spans
    print({k: round(found[k] / want[k], 3) for k in want}, "clean rows with spans", wrong, "of", clean)
    assert all(found[k] >= 0.9 * want[k] for k in want)
    assert wrong <= 0.05 * clean
