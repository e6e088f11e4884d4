"""What an operator may not do again and again: counted, not timed."""

from __future__ import annotations

import numpy as np

from presswork.llm import bagminhash, shingles, suffix, tokens
from presswork.llm.queries import tokenizer_path


def test_words_are_those_of_split():
    seps = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    near = [chr(ord(c) + d) for c in seps for d in (-1, 1) if not chr(ord(c) + d).isspace()]
    texts = ["", " ", "one", *(f"a{c}b {c}{c}c" for c in seps + near), "é" * 16 + " " + "é" * 17 + " x" * 9, "\ud800 z", "w" * 5000 + " w"]
    h, n = shingles.words(texts)
    lists = [t.split() for t in texts]
    assert n.tolist() == [len(w) for w in lists]
    flat = [w for words in lists for w in words]
    said = dict(zip(flat, h.tolist(), strict=True))
    assert [said[w] for w in flat] == h.tolist() and len(set(said.values())) == len(said)


def test_bags_count_and_order_as_plain_ones():
    rng = np.random.default_rng(3)
    x, owner = rng.integers(0, 1 << 63, 500, np.uint64), np.sort(rng.integers(0, 40, 500))
    x[::2] >>= np.uint64(60)  # many that are alike in their first bits
    assert (shingles._by_owner(x, owner, 40) == x[np.lexsort((x, owner))]).all()


def test_a_short_text_takes_few_passes(monkeypatch):
    """One shingle gives all points of a signature: over a thousand passes over the slice, when each drew one point."""
    passes = []
    monkeypatch.setattr(bagminhash, "mix", lambda h: passes.append(1) or shingles.mix(h))
    bag = shingles.bags(["word", "a b c d e f", "x " * 400])
    assert (bagminhash.bag_sketch(*bag) > 0).mean() > 0.99
    assert len(passes) < 60


def test_near_hashes_words_at_once(monkeypatch):
    """No word of ordinary length goes through Python for the bags of a slice."""
    asked = []
    plain = shingles.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(shingles.xxhash, "xxh3_64_intdigest", lambda b: asked.append(b) or plain(b))
    shingles._HASH.clear()
    shingles.bags([f"unheard{k} of{k}" for k in range(50)] + ["v" * 40])
    assert asked == [b"v" * 40]


def test_words_are_encoded_by_tokens_that_end_not_by_trying_slices(monkeypatch):
    """A word costs look-ups of the tokens that do end at a byte; before, one of each slice that might be a token."""
    merges = tokens.merge_table(tokenizer_path("word_bpe_49k.json"))
    asked = []

    class Told(dict):
        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

    monkeypatch.setattr(merges, "inner", Told(merges.inner))
    monkeypatch.setattr(merges, "final", Told(merges.final))
    raw = b"thonenoushingenandereation"
    assert len(merges.ends(raw)) == len(raw) and not asked


def test_words_asked_for_again_outlast_a_full_memory():
    """Before, a full memory forgot all words, frequent ones too."""
    answered = []
    memo = tokens.Memo(lambda w: answered.append(w) or w.upper(), 10)
    for k in range(40):
        assert memo["often"] == "OFTEN" and memo[f"rare{k}"] == f"RARE{k}"
    assert answered.count("often") == 1 and len(memo) + len(memo.older) <= 10


def test_windows_that_equal_no_other_are_not_sorted(monkeypatch):
    """Before, all windows of a block were sorted by 64 bytes each."""
    sorted_ = []
    plain = suffix._ranks
    monkeypatch.setattr(suffix, "_ranks", lambda words: sorted_.append(len(words[0])) or plain(words))
    bodies = [np.random.default_rng(k).integers(0, 256, 400, np.uint8).tobytes() for k in range(20)]
    label, count = suffix.first_equal(bodies)
    assert not sorted_ and (label == np.arange(20 * 301)).all()
    label, count = suffix.first_equal([*bodies, bodies[3][50:170]])
    assert max(sorted_) <= 42 * 6 and label[-21:].tolist() == list(range(3 * 301 + 50, 3 * 301 + 71))


def test_runs_are_marked_once(spark):
    """Three parts of the plan read the marks; before, each sorted all runs again."""
    texts = ["one two " * 40, "other", None, "one two " * 30 + "end"]
    df = suffix.repeat_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert "_mark(" not in df._jdf.queryExecution().toString()
    assert {r["doc_id"]: r["n_removed"] > 0 for r in df.collect()} == {0: True, 1: False, 2: False, 3: True}
