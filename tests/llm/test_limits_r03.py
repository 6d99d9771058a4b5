"""What keeps the operators of round 3 inside their limits."""

import random

import numpy as np
import public_tokenizers as P


def test_words_of_letters_skip_the_search_for_pieces():
    from mnemospark.llm.tokens import ByteEncoder

    class Counting:
        def __init__(self, real):
            self.real, self.seen = real, []

        def encode(self, text, **how):
            self.seen.append(text)
            return self.real.encode(text, **how)

    rng = random.Random(3)
    letters = [chr(c) for c in range(0x41, 0x260) if chr(c).isalpha()]
    words = ["".join(rng.choice(letters if k % 2 else letters[:52]) for _ in range(rng.randint(1, 12))) for k in range(2000)]
    e = ByteEncoder(P.path("byte_bpe_50k.json"))
    real = e.bare.tokenizer
    e.bare.tokenizer = e.spaced.tokenizer = Counting(real)
    for text in (*words, " ".join(words), "\n".join(words)):
        assert np.frombuffer(e.encode(text), "<u2").tolist() == real.encode(text, add_special_tokens=False).ids, text
    assert all(max(t) >= "ɐ" for t in e.bare.tokenizer.seen)


def test_language_model_passes_small_batches(spark):
    """No more than BATCH_ROWS texts reach a worker at once, and the setting is as before afterwards."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from mnemospark.llm import maxent_lm as M

    rng = random.Random(4)
    rows = [(k, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 30)))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    with M.small_batches(spark, 50):
        met = docs.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in bs), "n long").collect()
        assert max(r.n for r in met) == 50 and sum(r.n for r in met) == 300
        encoded = M.encode(docs, F.col("doc_id") % 10 != 0)
        sizes = {r.doc_id: (r.n_tokens, len(r["keys"]), r.learn) for r in encoded.collect()}
    assert sizes == {k: (n := len(t.split()) + 1, 8 * n, k % 10 != 0) for k, t in rows}
    assert spark.conf.get(name) == was


def test_keys_leave_a_worker_by_groups_of_texts(spark):
    """A batch of several groups comes back in as many batches, with each text's own keys."""
    from pyspark.sql import functions as F

    from mnemospark.llm import maxent_lm as M

    rows = [(k, " ".join(f"w{(k * 7 + i) % 50}" for i in range(9_000 + k))) for k in range(30)]
    assert sum(len(t.split()) for _, t in rows) > 2 * M.GROUP_TOKENS
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in M.encode(docs, F.col("doc_id") % 10 != 0).collect()}
    assert len(got) == 30
    for k, t in rows:
        assert (got[k].learn, got[k].n_tokens, bytes(got[k]["keys"])) == (k % 10 != 0, len(t.split()) + 1, M.keys_of(M.words_of(t)).tobytes())
