"""Chat, HTML, token counts, packing and classifiers against brute force, and their edge cases."""

import hashlib
import random
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.llm import chat, html, packing, quality_mil, queries, token_counts, toxicity
from sluice.llm.common import tokenizer_path

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

# --- chat ---

pieces = st.lists(st.sampled_from(["\\", "#", "###", "</turn>", "<", "/turn>", ": ", " ", "h", "t", "c", "\n", "é", " </turn>\n", "### User: ", "\\h", "\\\\"]), max_size=9).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["system", "user", "assistant", "tool"]) | pieces, pieces)
def test_template_round_trip(role, text):
    t = chat.Template()
    parts = t.segments(role, text)
    formatted = "".join(s for s, _ in parts)
    assert t.turn(formatted) == (role, text)
    assert t.unescape(t.escape(text)) == text
    assert formatted.count("</turn>") == 1 and formatted.startswith("###")
    assert [t.unescape(s) for s, loss in parts if loss] == ([text] if role == "assistant" else [])


def test_states():
    t = chat.Template()

    def walk(*roles):
        state = "start"
        for r in roles:
            state = t.step(state, r)
        return state in t.final

    assert walk("system", "user", "assistant") and walk("user") and walk("user", "assistant", "tool", "assistant")
    assert not walk() and not walk("assistant") and not walk("user", "user") and not walk("system") and not walk("user", "owl", "assistant")


def test_chat(spark):
    rng = random.Random(1)
    rows = [(7, 0, "user", "hi\nthere"), (7, 1, "assistant", "### User: </turn> \\"), (9, 0, "assistant", "early"), (9, 1, "owl: x", "odd"), (11, 0, "user", None), (11, 1, None, "y")]
    rows += [(12, 1, "assistant", "b"), (12, 1, "assistant", "a"), (12, 0, "user", ""), (None, None, "user", "z"), (None, 2, "assistant", "z"), (12, 1, "assistant", "a")]
    rows += [(100, k, ("user", "assistant")[k % 2], "t" * (k % 5)) for k in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumn("state", F.lit("x")).withColumn("loss", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(df)).collect()}
    low = lambda v: -1 if v is None else v
    assert set(got) == {7, 9, 11, 12, 100, None}
    for conv in got:
        turns = sorted(((low(t), r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[7].valid and got[100].valid and not got[9].valid and not got[11].valid and not got[12].valid
    text = "".join(r.text for r in sorted(chat.format_chat(df).where("conv_id = 7").collect(), key=lambda r: (r.turn_no, r.segment)))
    assert len(text) == got[7].formatted_chars
    assert text == "### User: hi\nthere </turn>\n### Assistant: \\hUser: should".replace("\\hUser: should", "\\h User: \\t \\\\ </turn>\n")
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0


# --- html ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site to give you what you want and more of it, so accept.</div>
<!-- <p>hidden</p> --><div id="sidebar"><p>Many words stand here, in a box beside the text, that nobody asked for at all.</p></div>
<article><h1>Title &amp; more</h1><p>First  paragraph\n of the <b>text</b>, with a <a href="x">link</a> in it &lt;here&gt; &#233;&eacute;.</p>
<div class="ad">Buy this now, it is cheap, and good, and everybody has it already, so hurry up please.</div>
<p>Second a < b and 3 > 2<p>Third<br>line</p>
<form><p>Your mail address please</p><textarea>x</textarea></form>
<section class="comments"><p>I liked this article very much, thank you for writing it, and all the best.</p></section>
</article><aside><p>Related</p></aside><footer>&copy; Somebody</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "Title & more\nFirst paragraph of the text, with a link in it <here> éé.\nSecond a < b and 3 > 2\nThird\nline"


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<", "<"[:0]), ("<article>x", "x"), ("<article><p>x &am", "x &am"), ("<article>x</arti", "x"), ("<article>x<a href='", "x"),
        ("<article><script>if (a<b) {</article>", ""), ("<article><p>a</p></article><article><p>b</p></article>", "a\nb"), ("<ARTICLE><P>A\t\nB</P></ARTICLE>", "A B"),
        ("<nav><article>x</article></nav>", ""), ("<article><!-- x", ""), ("<article>\ud800x</article>", "\ud800x"), ("<article>&#0;&#x110000;x</article>", "��x"),
    ],
)
def test_main_text_edges(page, text):
    assert html.main_text(page) == text


def test_long_pages_are_linear():
    page = "<article>" + "<div><p>word <b>x</b>" * 20_000 + "</article>"
    assert html.main_text(page).count("word") == 20_000
    assert html.main_text("<article>" + "<" * 100_000 + "</article>").startswith("<")
    assert html.main_text("<article>" + "<a \"" * 3_000) == ""


def test_tree_fits_its_table():
    x, y = html.labelled()
    assert [html.verdict(html.tree(), list(r)) for r in x] == y.tolist()


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", PAGE)], "page_id bigint, url string, html string").withColumn("text", F.lit(1))
    got = html.extract(df).collect()
    assert sorted((r.page_id or 0, r.url or "", r.n_chars) for r in got) == [(0, "v", 0), (1, "u", len(html.main_text(PAGE))), (1, "u", len(html.main_text(PAGE))), (2, "", 0)]
    assert html.extract(df.limit(0)).count() == 0


# --- token counts ---


@pytest.fixture(scope="module")
def unigram():
    return token_counts.Unigram(token_counts.read_pieces(tokenizer_path("piece_bpe_32k.model")))


def brute_count(model, word):
    token = token_counts.MARK + word
    best = [(0.0, 0)]
    for i in range(1, len(token) + 1):
        found = [(best[j][0] + model.score[token[j:i]], best[j][1] - 1) for j in range(i) if token[j:i] in model.score]
        if token[i - 1] not in model.score:
            n = len(token[i - 1].encode())
            found.append((best[i - 1][0] + n * model.byte, best[i - 1][1] - n))
        best.append(max(found))
    return -best[-1][1]


def forget(model):
    model.young.clear()
    model.old.clear()
    model.nodes = 0


def brute_counts(model, texts):
    return [(len(w), sum(brute_count(model, x) for x in w)) for w in ([x for x in re.split("[ \t\n\x0b\x0c\r]", t or "") if x] for t in texts)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text("abcdetion▁éß日🙂.\x85\u3000", max_size=12), max_size=12).map(" \t".join), max_size=4))
def test_token_counts(unigram, texts):
    forget(unigram)
    assert unigram.counts(texts) == brute_counts(unigram, texts)
    # every prefix that the batch holds is computed once, and nothing twice
    words = {token_counts.MARK + w for t in texts for w in re.split("[ \t]", t) if w}
    assert unigram.nodes == len({w[:i] for w in words for i in range(1, len(w) + 1)})
    assert unigram.counts(texts) == brute_counts(unigram, texts)
    assert unigram.nodes == len({w[:i] for w in words for i in range(1, len(w) + 1)})


def test_token_counts_with_a_small_memory(unigram, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 2)
    monkeypatch.setattr(token_counts, "LONGEST", 3)
    forget(unigram)
    for texts in (["a b c d e f"], ["a longer"], ["b"], ["c a longer", "", None], ["d e f g h"]):
        assert unigram.counts(texts) == brute_counts(unigram, texts)
        assert len(unigram.young) <= 2 + 6 and not any(len(w) > 3 for w in unigram.young)


def test_token_counts_query(spark, unigram):
    texts = ["the cat sat", None, "", "\x0b\x0c", "the the\nthe", "x" * 3000, "the cat sat"]
    df = spark.createDataFrame([(None if k == 4 else k, t, "en", "s", 0) for k, t in enumerate(texts)], DOCS).withColumn("n_tokens", F.lit("x"))
    got = {(r.doc_id, r.n_words, r.n_tokens) for r in token_counts.token_counts(df, tokenizer_path("piece_bpe_32k.model")).collect()}
    assert got == {(None if k == 4 else k, *n) for k, n in enumerate(brute_counts(unigram, texts))}
    assert token_counts.token_counts(df.limit(0), tokenizer_path("piece_bpe_32k.model")).count() == 0
    large = (1 << 60) + 1  # ids stay exact beside nulls
    both = spark.createDataFrame([(large, "a"), (None, "b")], "doc_id bigint, text string").coalesce(1)
    assert {r.doc_id for r in token_counts.token_counts(both, tokenizer_path("piece_bpe_32k.model")).collect()} == {large, None}


# --- packing ---


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(tokenizer_path("word_bpe_49k.json"))


ODD = ["İstanbul ΣΑΣ naïve é Å", "<|endoftext|> a<|startoftext|>b", "it's don't 'll x'Re", "a\tb\x0bc d\x85e\x1cf", "a..b ...! word.%%% (x). \"y\",", "ß ẞ ﬁ Ǆ ŉ 日本語 🙂", "\n\n a \n", "x" * 70 + "." * 70]


@settings(max_examples=200, deadline=None)
@given(st.text() | st.lists(st.sampled_from([*ODD, "the", "The,", "word.\n", "### ", "1a2", "é!", " "]), max_size=8).map(" ".join))
def test_ids_are_the_tokenizer_s(encoder, text):
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    got, ends = encoder.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == want
    assert all(0 < e <= len(want) for e in ends)


def test_ids_with_a_small_memory(encoder, monkeypatch):
    fresh = packing.Encoder(tokenizer_path("word_bpe_49k.json"))
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    monkeypatch.setattr(packing, "LETTERS", 2)
    monkeypatch.setattr(packing, "SIGN_RUNS", 2)
    for text in [*ODD, "a b c d e f", "a. b, c! d? e; f: g..", "b a"] * 2:
        assert fresh.encode(text)[0] == encoder.encode(text)[0]


def test_ids_of_many_texts_at_once(encoder, monkeypatch):
    fresh = packing.Encoder(tokenizer_path("word_bpe_49k.json"))
    assert fresh.by_model
    monkeypatch.setattr(packing, "WORDS", 7)
    texts = ["", *ODD, "", "Stone river. Wind!\nÉté, l'été ÀÉÎ<|", "a" * 64 + " " + "b" * 65 + " " + "!" * 200, ""]
    for by_model in (True, False):  # False: a file that takes letters otherwise
        fresh.by_model = by_model
        fresh.letters.clear()
        for some in (pa.array(texts), pa.array(["x", *texts, "y"])[1:-1], pa.array(["", ""]), pa.array([], pa.string())):
            ids, at, ends = fresh.encode_all(some)
            assert at[0] == 0 and len(at) == len(some) + 1 and at[-1] == len(ids)
            for k, text in enumerate(some.to_pylist()):
                want, stops = encoder.encode(text)
                assert ids[at[k] : at[k + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
                assert ids[at[k] : at[k + 1]].tobytes() == want
                assert (ends[(ends > at[k]) & (ends <= at[k + 1])] - at[k]).tolist() == stops.tolist()


def test_packing_many_documents_at_once():
    rng = np.random.default_rng(2)
    sizes = [0, 5, 0, 300, 64, 65, 1, 0]
    at = np.cumsum([0, *sizes])
    ids = rng.integers(3, 99, at[-1]).astype("<u4")
    ends = np.unique(rng.integers(1, at[-1] + 1, 40))
    for size in (1, 32, 128):
        one, many = packing.Stream(0, size), packing.Stream(0, size)
        want = [p for k in range(len(sizes)) for p in one.add(k, ids[at[k] : at[k + 1]].tobytes(), ends[(ends > at[k]) & (ends <= at[k + 1])] - at[k])]
        found = list(many.add_all(list(range(len(sizes))), ids, at, ends))
        assert found + list(many.pack(True)) == want + list(one.pack(True))


def test_packing_calls_little_for_each_document_and_word(spark, monkeypatch):
    class Frame:  # keeps what would run on the executors
        def select(self, *columns):
            return self

        def mapInArrow(self, work, schema):
            self.work = work
            return self

    monkeypatch.setattr(packing, "TaskContext", type("Task", (), {"get": classmethod(lambda cls: cls), "partitionId": staticmethod(lambda: 0)}))
    work = packing.pack(Frame(), tokenizer_path("word_bpe_49k.json")).work
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = [f"{word()} {word()}, {word()} {word()}. Then the stone, the river and the wind. " * 3 for _ in range(900)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(900)), pa.array(texts)], names=["doc_id", "text"])
    list(work(iter([batch.slice(0, 1)])))  # the file is loaded
    calls = [0]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found = list(work(iter([batch])))
    finally:
        sys.setprofile(None)
    assert len({i for b in found for i in b.column("doc_id").to_pylist()}) == 900
    assert calls[0] < 90 * 900, calls[0] / 900


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.integers(0, 4)), min_size=1, max_size=9))
def test_windows_are_optimal(items):
    at, cost = np.cumsum([n for n, _ in items]).tolist(), [c for _, c in items]
    size, n = 8, len(items)
    best = None
    for mask in range(1 << (n - 1)):
        cuts = [at[k] for k in range(n - 1) if mask >> k & 1] + [at[-1]]
        steps = np.diff([0, *cuts])
        if max(steps) <= size:
            price = sum(size - s for s in steps[:-1]) + sum(cost[at.index(c)] for c in cuts)
            best = price if best is None else min(best, price)
    cuts = packing.windows(at, cost, size)
    steps = np.diff([0, *cuts])
    assert max(steps) <= size and sum(size - s for s in steps[:-1]) + sum(cost[at.index(c)] for c in cuts) == best


def check_pieces(rows, want, size):
    """want: doc_id -> (tokens, ids) of rows; ids None for repeated documents."""
    sequences, parts = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        parts.setdefault(r.doc_id, []).append(r)
    padding = total = 0
    for found in sequences.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end and length > 0
            end += length
        assert end <= size
        total += end
        padding += 0 if end & (end - 1) == 0 else size - end
    assert set(parts) == set(want)
    for doc, found in parts.items():
        ids = want[doc]
        end = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == end and r.doc_tokens == len(ids)
            end += r.length
            assert bytes(r.ids) == np.array(ids[r.start : end], "<u4").tobytes()
        assert end == len(ids)
    return padding, total


def test_packing(spark, encoder, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["stone", "river.", "Wind,", "tree!\n", "light"]) for _ in range(rng.choice([0, 3, 50, 400, 3000]))) for _ in range(60)] + [None, "", " \n", "x" * 4000, "no stop " * 4000]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOCS).repartition(3).withColumn("start", F.lit("x")).withColumn("length", F.lit("x"))
    rows = packing.pack(df, tokenizer_path("word_bpe_49k.json")).collect()
    want = {k: [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for k, t in enumerate(texts)}
    padding, total = check_pieces(rows, want, 4096)
    assert padding < 0.05 * total
    assert packing.pack(df.limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0
    # many blocks, and order kept inside the stream
    monkeypatch.setattr(packing, "BLOCK", 500)
    stream, out = packing.Stream(0, 128), []
    for k, t in enumerate(texts):
        out += stream.add(k, *encoder.encode(t or ""))
    out += stream.pack(True)
    from types import SimpleNamespace

    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    check_pieces([SimpleNamespace(**dict(zip(names, p))) for p in out], want, 128)
    assert [p[0] for p in out] == sorted(p[0] for p in out)
    assert [p[5] for p in out] == sorted(p[5] for p in out)


def test_packing_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c.", "en", "s", 0)] * 3 + [(None, "d", "en", "s", 0)], DOCS).coalesce(1)
    rows = packing.pack(df, tokenizer_path("word_bpe_49k.json")).collect()
    assert sum(r.length for r in rows) == 3 * 5 + 2 and {r.doc_id for r in rows} == {1, None}


# --- classifiers ---


def labelled_docs(spark, n=600):
    rng = random.Random(9)
    stems = ["stone", "river", "wind", "tree", "light", "house", "road", "field"]
    word = lambda: rng.choice(stems) + rng.choice(["", "s", "y", "ing", "er"])
    rows, labels = [], []
    for k in range(n):
        words = [word() for _ in range(rng.randrange(20, 120))]
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        if toxic:
            for _ in range(2):
                bad = rng.choice(["wretch", "dimwit", "blockhead"])
                cut = rng.randrange(1, len(bad))
                bad = rng.choice([bad, bad, bad[:cut] + bad[cut] + bad[cut:]])
                words.insert(rng.randrange(len(words)), bad)
        if not good:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [w + "&&&" for w in words]
        rows.append((k, " ".join(words), "en", "s", 0))
        labels.append((k, int(good), int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("module, label, threshold", [(quality_mil, "quality", 0.3), (toxicity, "toxic", 0.5)])
def test_classifier(spark, module, label, threshold):
    docs, labels = labelled_docs(spark)
    model = module.fit(docs, labels)
    odd = spark.createDataFrame([(9000, None, None, None, None), (9001, "", "en", "s", 0), (None, "stone", "en", "s", 0), (9002, "stone river " * 20_000, "en", "s", 0)], DOCS)
    df = docs.unionAll(odd).unionAll(odd).withColumn("score", F.lit("x")).withColumn("quality", F.lit("x")).withColumn("toxicity", F.lit("x"))
    got = module.classify(df, model).collect()
    truth = {r.doc_id: r[label] for r in labels.collect()}
    assert len(got) == docs.count() + 8
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 60
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    keep = quality_mil.keep_good if module is quality_mil else toxicity.keep_clean
    kept = keep(df, model)
    assert kept.columns == df.columns
    assert kept.where("doc_id = 9002").count() == 2
    assert module.classify(df.limit(0), model).count() == 0
    none = module.fit(docs, labels.limit(0))
    assert keep(docs, none).count() == docs.count()


def test_held_out_labels_teach_nothing(spark):
    docs, labels = labelled_docs(spark, 200)
    wrong = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, wrong)
    assert np.array_equal(a.bucket, b.bucket) and a.bias == b.bias


def test_attention_gradient():
    """The trained model puts its weight on the passage that makes a document bad."""
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(["stone", "river", "wind"]) for _ in range(32))
    junk = lambda: " ".join(rng.choice(["stone###", "river&&&"]) for _ in range(32))
    sample = []
    for _ in range(150):
        parts = [text() for _ in range(6)]
        bad = rng.random() < 0.5
        if bad:
            parts[rng.randrange(6)] = junk()
        sample.append((" ".join(parts), int(not bad)))
    model = quality_mil.train(sample)
    x = quality_mil.Encoder().passages(" ".join([text(), text(), junk(), text()]))
    out = model.forward((x - model.mean) / model.scale, np.zeros(4, int), np.zeros(1, int))
    assert out[3].argmax() == 2 and out[-1][0] < 0.5


# --- the pipeline ---


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled_docs(spark, 300)
    copies = docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 5000)
    docs.unionAll(copies).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "mixture", "packing"]
    truth = {r.doc_id: r for r in labels.collect()}
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        ids = [r.doc_id for r in now.collect()]
        assert ids
        if name == "quality":
            good = {i for i in truth if truth[i].quality}
            assert len(set(ids) & good) >= 0.97 * len(good) and len(set(ids) - good - {i + 5000 for i in good}) <= 0.03 * len(truth)
        if name == "near_duplicates":
            assert max(ids) < 5000 and len(ids) == len(set(ids))
        if name != "packing":
            assert now.columns == names
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, now.collect()), key=str)


@pytest.fixture(scope="module")
def odd_pipeline(spark, tmp_path_factory):
    """A table of nulls, repeated rows, long texts and clashing columns beside ordinary documents."""
    path = tmp_path_factory.mktemp("odd")
    docs, labels = labelled_docs(spark, 300)
    long = " ".join(f"stone river wind {k}" for k in range(20_000))
    text = "stone river wind tree light " * 20
    odd = [(7000, None, "en", "s", 0), (7001, "", "en", None, None), (None, text + "a", None, "s", 0), (None, text + "a", None, "s", 0), (7002, long, "en", "t", 0), (7003, long, "en", "t", 0), (7004, text, "en", "s", 0), (7004, text, "en", "s", 0)]
    docs = docs.unionAll(spark.createDataFrame(odd, DOCS))
    for name in ("quality", "toxicity", "fp", "component_id", "rate", "copies", "size", "start", "sequence_id"):
        docs = docs.withColumn(name, F.lit(f"my {name}"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline_stages_on_odd_rows(spark, odd_pipeline):
    import corpus_pipeline

    now = spark.read.parquet(f"{odd_pipeline}/documents.parquet")
    names, frames = now.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, odd_pipeline).write.parquet(f"{odd_pipeline}/{k}")
        now = spark.read.parquet(f"{odd_pipeline}/{k}")
        frames[name] = now
        if name != "packing":
            assert now.columns == names
            assert not now.where("quality <> 'my quality' or sequence_id <> 'my sequence_id'").count()
    ids = {name: [r.doc_id for r in df.select("doc_id").collect()] for name, df in frames.items()}
    assert ids["quality"].count(7002) == ids["quality"].count(7003) == 1  # long texts, all of them read
    assert ids["toxicity"].count(None) == 2 and ids["toxicity"].count(7004) == 2
    # toxic words go, whatever else is in the text
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{odd_pipeline}/labels.parquet").collect()}
    seen = [i for i in ids["quality"] if i in truth]
    right = sum((i in set(ids["toxicity"])) == (not truth[i]) for i in seen)
    assert right >= 0.95 * len(seen)
    # one of the long copies, one row of the repeated id, and both rows without an id
    assert ids["near_duplicates"].count(7002) == 1 and 7003 not in ids["near_duplicates"]
    assert ids["near_duplicates"].count(7004) == 1 and ids["near_duplicates"].count(None) == 2
    # each document as often as the mix says, and each of its tokens once per copy
    from collections import Counter

    taken = Counter(ids["mixture"])
    assert set(taken) <= set(ids["near_duplicates"]) and max(taken[i] for i in taken if i is not None) <= 2
    lengths = {r.doc_id: r for r in frames["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()}
    assert set(lengths) == set(taken) and all(r.n == r.all * taken[i] for i, r in lengths.items())


def test_pipeline_cleans_up_and_takes_empty_tables(spark, odd_pipeline, tmp_path):
    import os

    import corpus_pipeline
    from sluice.llm import common

    common.release(spark)
    folder = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    settings = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None)
    for name in ("documents", "labels"):
        spark.read.parquet(f"{odd_pipeline}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    left = set(os.listdir(folder)) - before
    assert not common.cuts() and len(left) == 1 and os.listdir(f"{folder}/{left.pop()}") == ["packing"]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) == settings


def test_packing_query(spark, encoder, tmp_path):
    text = "one two, three. " * 2000
    spark.createDataFrame([(5, text, "en", "s", 0)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    ids = [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 2]
    rows = queries.queries()["op9_packing"](spark, str(tmp_path)).collect()
    assert sum(r.length for r in rows) == len(ids)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_queries_are_registered():
    import __spark_entry__

    for n in range(1, 11):
        assert len([k for k in __spark_entry__.queries() if k.startswith(f"op{n}_")]) == 1
    assert "pipeline" in __spark_entry__.queries()
    assert set(queries.oracle_sql()) <= set(queries.queries())
