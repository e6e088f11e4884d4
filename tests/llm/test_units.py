"""The operators' cores against brute force, without Spark."""

from __future__ import annotations

import random
from array import array

import numpy as np
import pyarrow as pa
import pytest

from presswork.llm import bagminhash, exact, html, langid, minhash, mixing, quality, shingles, suffix, tokens
from presswork.llm.queries import tokenizer_path

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
R = random.Random(7)
ODD = ["", " ", "a", "don't we'LL I'm 's '", "a<|endoftext|>b", "x  <|endoftext|>  y", "<|startoftext|>Hi", "ΑΣ ΣΑΣ", "é Å", "՘ \U00018e00", "ᲉꟋ", "a" * 5000, "=" * 3000 + "!"]
ODD += ["".join(R.choice("ab'sre vedll  \n\t\x1c\x85é漢Σİß0١²ⅷ!?-_.,<|가😀ـ") for _ in range(R.randint(0, 50))) for _ in range(300)]


def test_encoding_and_decoding_as_the_library():
    from tokenizers import Tokenizer

    lib, t = Tokenizer.from_file(WORD), tokens.Transducer(WORD)
    for text in ODD:
        ids = array("I", b"".join(t.stream(text)))
        assert list(ids) == lib.encode(text, add_special_tokens=False).ids
        assert tokens.Decoder(t.m).feed(ids) == lib.decode(list(ids), skip_special_tokens=False)


def test_stream_is_the_same_in_any_pieces():
    t = tokens.Transducer(WORD)
    small = tokens.Transducer(WORD, run_chars=50)
    for text in ODD + [" ".join(ODD)]:
        assert b"".join(t.stream(text)) == b"".join(small.stream(text))
    word = "".join(R.choice("theranding") for _ in range(9000)).encode()
    whole = t.m.encode_word(word)
    for size in (1, 7, 1000):
        w, out, most = tokens.WordTransducer(t.m, t.lookahead), [], 0
        for at in range(0, len(word) if size > 1 else 1500, size):
            out += w.feed(word[at : at + size])
            most = max(most, len(w.data))
        if size > 1:
            assert out + w.close() == whole
        assert most <= t.lookahead + 3 * t.m.longest + 2 * size


def test_texts_without_white_space_stream():
    from tokenizers import Tokenizer

    lib, draw = Tokenizer.from_file(WORD), random.Random(4)
    texts = ["".join(draw.choice("ab'sre12é漢Σİ!?-\u0301\u1100\u1161\u11a8\u0f73가😀") for _ in range(draw.randint(1, 400))) for _ in range(150)]
    texts += ["x" * 3000 + "'re" + "!" * 999 + "'s", "漢字" * 2000, "a" * 49 + "'re", "é" * 700 + "\u0301" * 200 + "b"]
    for size in (4, 9, 50):
        t = tokens.Transducer(WORD, run_chars=size)
        for text in texts:
            assert list(array("I", b"".join(t.stream(text)))) == lib.encode(text, add_special_tokens=False).ids
    t, most = tokens.Transducer(WORD, run_chars=1000), 0
    for piece in t.stream("theran" * 50_000):
        most = max(most, len(piece))
    assert most < 4 * 2500


def test_counts_in_runs(monkeypatch):
    from tokenizers import Tokenizer

    lib, c = Tokenizer.from_file(BYTE), tokens.Counter(BYTE)
    for size in (3, 20):
        monkeypatch.setattr(tokens, "RUN_CHARS", size)
        for text in [*ODD, " ".join(ODD)]:
            assert c.count(text) == len(lib.encode(text, add_special_tokens=False).ids)


def test_incremental_decoding():
    from tokenizers import Tokenizer

    t, lib = tokens.Transducer(WORD), Tokenizer.from_file(WORD)
    for text in ["héllo 😀 wörld", *ODD]:
        ids = array("I", b"".join(t.stream(text)))
        d, one = tokens.Decoder(t.m), tokens.Decoder(t.m)
        assert "".join(one.feed([i]) for i in ids) == d.feed(ids) == lib.decode(list(ids), skip_special_tokens=False)
    ids = array("I", b"".join(t.stream("héllo 😀 wörld")))
    d = tokens.Decoder(t.m)
    assert "".join(d.readable([i]) for i in ids) + d.readable([], True) == "héllo 😀 wörld "


def test_prefix_counts():
    from tokenizers import Tokenizer

    lib, c = Tokenizer.from_file(BYTE), tokens.Counter(BYTE)
    for text in [x[:120] for x in ODD]:
        want = [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert list(c.prefixes(text)) == want and c.count(text) == want[-1]
        for budget in (0, 1, 5):
            cut = c.truncate(text, budget)
            assert want[len(cut)] <= budget and all(n > budget for n in want[len(cut) + 1 :])


def test_patricia():
    keys = [bytes(R.choice(b"ab") for _ in range(R.randint(0, 12))) for _ in range(400)]
    trie, seen = exact.Patricia(), {}
    for k, key in enumerate(keys):
        assert trie.owner(key, lambda k=k: k) == seen.setdefault(key, k)


def test_pfair_lag():
    slots = mixing.quantised({"a": 0.5, "b": 0.3, "c": 0.001, "d": 0.199}, 97)
    assert sum(slots.values()) == 97 and min(slots.values()) >= 1


def brute_first(bodies):
    seen, out = {}, []
    for b in bodies:
        for s in range(len(b) - 99):
            out.append(seen.setdefault(b[s : s + 100], len(out)))
    return out


def test_suffix_sort():
    assert sorted({(a - b) % 31 for a in suffix.COVER for b in suffix.COVER}) == list(range(31))
    base = bytes(R.choice(b"abc") for _ in range(900))
    bodies = [b"a" * 300, b"ab" * 150, b"x" * 100]
    for _ in range(60):
        a = R.randint(0, 700)
        body = bytearray(base[a : a + R.randint(100, 200)])
        if R.random() < 0.5:
            body[R.randrange(len(body))] = 100
        bodies.append(bytes(body))
    label, count = suffix.first_equal(bodies)
    assert label.tolist() == brute_first(bodies) and count.sum() == len(label)


def test_marks_and_sorts_across_batches():
    rows = sorted((R.randint(0, 6), R.randint(0, 1), R.randint(0, 1), d, d, R.randint(0, 1) | 2, False) for d in range(80))
    whole = _marks(rows, 1000)
    kinds = {k: len({(c, m) for kk, c, m, *_ in rows if kk == k}) for k, *_ in rows}
    first = {}
    want = set()
    for k, c, m, d, _, loc, _ in rows:
        new = first.setdefault((k, c, m), d) == d
        if not new or kinds[k] > 1 or loc & 1:
            want.add((d, new))
    assert whole == want
    for size in (1, 2, 3, 7):
        assert _marks(rows, size) == want


def _marks(rows, size):
    def batches():
        for at in range(0, len(rows), size):
            cols = list(zip(*rows[at : at + size], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if k == 6 else pa.int64()) for k, c in enumerate(cols)], names=["key", "content", "more", "doc", "row", "loc", "copy"])

    out = [r for b in suffix._mark(batches()) for r in b.to_pylist()]
    assert len(out) == len({r["row"] for r in out})
    return {(r["row"], r["sorts"]) for r in out}


def test_a_bucket_larger_than_a_block(monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 1500)
    base = bytes(R.choice(b"abc") for _ in range(400))
    bodies = [base[a : a + 130] for a in (R.randint(0, 270) for _ in range(150))]
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 150), pa.array(range(150)), pa.array([0] * 150), pa.array(bodies, pa.binary())], names=["key", "row", "start", "body"])
    got = set()
    for b in suffix._sort(iter([batch.slice(0, 60), batch.slice(60)])):
        got |= {(r["row"], s) for r in b.to_pylist() for s in range(r["lo"], r["hi"])}
    first = brute_first(bodies)
    at = [(k, s) for k, b in enumerate(bodies) for s in range(len(b) - 99)]
    assert got == {w for n, w in enumerate(at) if first[n] != n}


def test_removed_spans():
    assert suffix.removed_spans([5, 0, 200], [6, 1, 201]) == [(0, 105), (200, 300)]
    assert suffix.removed_spans([], []) == []


def test_signatures_estimate():
    words = [f"w{i}" for i in range(400)]
    a, b = " ".join(words), " ".join(words[:300] + [f"v{i}" for i in range(100)])
    own = minhash.fingerprints_of([a, b, a, "", " ", "one"])
    bag = shingles.bags([a, b])
    one, two = (bag[0][: bag[2][0]], bag[1][: bag[2][0]]), (bag[0][bag[2][0] :], bag[1][bag[2][0] :])
    true = shingles.likeness(one, two, False)
    assert abs((own[0] == own[1]).mean() - true) < 0.15 and (own[0] == own[2]).all() and (own[3] == own[4]).all() and not (own[3] == own[5]).any()
    rep = shingles.bags(["x y z u v " * 9 + a, "x y z u v " * 4 + a])
    s = bagminhash.bag_sketch(*rep, 3000)
    p, q = (rep[0][: rep[2][0]], rep[1][: rep[2][0]]), (rep[0][rep[2][0] :], rep[1][rep[2][0] :])
    assert abs((s[0] == s[1]).mean() - shingles.likeness(p, q, True)) < 0.04


def test_short_texts_are_one_shingle():
    x, n = shingles.shingles(["a b", "", "a b c d e", "a  b", "b a", "a b c d e f"])
    assert n.tolist() == [1, 0, 1, 1, 1, 2] and x[0] == x[2] and x[0] != x[3] and x[1] == x[4]


def test_codes_and_languages():
    code = langid.codebook(4)
    assert code.shape == (4, 7) and min((code[i] != code[j]).sum() for i in range(4) for j in range(i)) == 4
    assert langid.codebook(12).shape[0] == 12
    rows = [(f"the quick one number {i} and then", "en") for i in range(60)] + [(f"der schnelle ist und nicht {i} auch", "de") for i in range(60)]
    predict = langid.predictor(langid.fit(iter(rows)))
    assert predict("then the one")[0] == "en" and predict("und nicht auch")[0] == "de"
    assert predict(None)[0] == predict("12 !?")[0] == predict("")[0] == "und"
    assert langid.predictor(langid.fit(iter([])))("text")[0] == "und" and langid.predictor(langid.fit(iter(rows[:3])))("text")[:2] == ("en", 1.0)
    long = "the one " * 100_000
    assert np.allclose(langid.bit_scores(long, np.ones((1 << 16, 2), np.float32), np.zeros(2)), 12.0)


def test_classifier():
    rows = [("fine words in order here", 1), ("BAD!! NOISE!! LOUD!!", 0)] * 40
    score = quality.scorer(quality._dump(quality.fit(iter(rows))))
    p = score(["fine words here", "LOUD!! NOISE!! OH!!", "", "w " * 100_000])
    assert p[0] > 0.7 and p[1] < 0.3 and 0 <= p[2] <= 1 and 0 <= p[3] <= 1
    assert quality.scorer(quality._dump(quality.fit(iter([]))))(["x", ""]).tolist() == [0.5, 0.5]


def test_classifier_reads_all_of_a_text_without_white_space():
    draw = random.Random(3)
    good = ["".join(chr(draw.randint(0x4E00, 0x9FA0)) for _ in range(400)) for _ in range(60)]
    bad = [g[:64] + "".join(draw.choice("=x7%A") for _ in range(336)) for g in good]
    score = quality.scorer(quality._dump(quality.fit((t, y) for pair in zip(good[:50], bad[:50], strict=True) for t, y in zip(pair, (1, 0), strict=True))))
    assert min(score(good[50:])) > 0.6 and max(score(bad[50:])) < 0.4
    text = "".join(chr(draw.randint(0x4E00, 0x9FA0)) for _ in range(1000))
    assert "".join(quality.words_of(text)) == text and quality.words_of("a " + "b" * 64) == ["a", "b" * 64]


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, None), ("", ""), ("<p>a<p>b", "a\n\nb"), ("a<br>b", "a\nb"), ("<title>t</title><script>s</script>x", "x"), ("<div hidden>n<p>o</div>y", "y"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"), ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"), ("<pre>a\n  b</pre>", "a\n  b"), ("a &amp; <b>b</b>  c", "a & b c"),
        ("<table><tr><td>aa<td>b<tr><td>c<td>dd</table>", "aa | b\nc  | dd"), ("<table><td>x<p>y</table>", "x\n\ny"), ("<span style='visibility:hidden'>a<b style='visibility: visible'>b</b></span>", "b"),
        ("<!-- x", ""), ("a<b", "a"), ("</p>x</div>", "x"), ("a" + "<div>" * 5000 + "b", "a\nb"), ("<tr><td>loose", "loose"),
    ],
)
def test_html(source, text):
    assert html.render(source) == text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A | B\n  | C"),
        ("<table><tr><td>a<td rowspan=2>b<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>", "a | b | c\nd |   | e\nf | g | h"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a | b\n  | c\n  | d"),
        ("<table><tr><td rowspan=2 colspan=2>ab<td>c<tr><td>d</table>", "ab  | c\n |  | d"),
        ("<table><tr><td>漢字<td>x<tr><td>abcd<td>y<tr><td>e\u0301<td>z</table>", "漢字 | x\nabcd | y\ne\u0301    | z"),
        ("a<object data=x><p>fall back</object>b", "a\n\nfall back\n\nb"),
        ("a<dialog>no</dialog><dialog open>yes</dialog>b", "a\nyes\nb"),
        ("<details><summary>s</summary>t<p>u</details><details open><summary>v</summary>w</details>", "s\nv\nw"),
        ("<math><mi>m</mi></math>", "m"),
    ],
)
def test_html_spans_and_shown_parts(source, text):
    assert html.render(source) == text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<html><head><title>x</title><p>Hello", "Hello"),
        ("<head><meta charset=utf-8><h1>A</h1><p>b", "A\n\nb"),
        ("<html><head><style>p{}</style><script>1<2</script> \n loose <b>text</b>", "loose text"),
        ("<head><link rel=x><noscript><p>off</p></noscript><base href=/><div>on</div>", "on"),
        ("<head><title>x</title></html>late", "late"),
        ("<head><template><p>t</p></template>&nbsp;a", "\xa0a"),
        ("<head><title>x</title></head><p>a<head><p>b", "a\n\nb"),
    ],
)
def test_html_head_without_its_end_tag(source, text):
    assert html.render(source) == text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<p>Sales <svg><text>42</text></svg> units", "Sales 42 units"),
        ("a<svg><title>t</title><desc>d</desc><defs><text>n</text></defs><path d='M0'/><g><text x=1>Jan</text><text>Fe<tspan>b</tspan></text></g></svg>b", "a Jan Feb b"),
        ("<svg><style>text{}</style><title/><symbol><text>s</text></symbol><text><title>tip</title>one</text> stray <metadata>m</metadata></svg>", "one"),
        ("<svg><text display=none>a</text><g visibility='hidden'><text>b</text></g><text style='display:none'>c</text><text>d</text></svg>", "d"),
        ("<svg><foreignObject><div>x<p>y</div></foreignObject><text>z</text></svg>", "x\n\ny\n\nz"),
        ("<svg><defs><p>out", "out"),
        ("<head><svg><text>a</text></svg>", "a"),
        ("<td><svg><g><text>a</text></td></svg>b", "a\nb"),
        ("<svg hidden><text>a</text></svg>b", "b"),
        ("<p>If <math> <mi>x</mi> <mo>&lt;</mo> <mn>1</mn> </math> then", "If x<1 then"),
        ("<math><semantics><mi>y</mi><annotation>tex</annotation><annotation-xml><mi>q</mi></annotation-xml></semantics></math>!", "y!"),
        ("<math><mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr></mtable></math>", "1 2"),
        ("a<math display=block><mi>b</mi></math>c", "a\nb\nc"),
        ("<table><tr><td><svg><text>k</text></svg><td>v</table>", "k | v"),
        ("<svg><a href=x/><text>l</text></a></svg><b>m</b>", "l m"),
        ("<svg>" * 3000 + "<text>deep", "deep"),
    ],
)
def test_html_svg_and_math(source, text):
    assert html.render(source) == text
