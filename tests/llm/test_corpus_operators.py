"""The corpus operators against plain versions, with awkward rows."""

import random

import numpy as np
import plain
import pytest
import sentencepiece
from pyspark.sql import functions as F

from teleloom.llm import chat_format, decontamination, exact_dedup, language_id, mixing, phrase_dedup, quality, secret_scan, simhash_dedup, textbytes, token_counts
from teleloom.llm.common import components
from teleloom.llm.queries import tokenizer_path

# Extra columns whose names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, copy int, fp long, k long, n long"


def frame(spark, rows, langs=None):
    full = [(i, t, (langs or {}).get(i, "en"), f"src{i % 3}" if i % 7 else None, None, 0.5, True, 9, 1, 2, 3) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def sentence(r, n):
    return [r.choice("abcdefghij") + r.choice("klmnop") + str(r.randrange(60)) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, blanks and nothing at all."""
    r = random.Random(3)
    texts = [" ".join(sentence(r, r.randrange(1, 60))) for _ in range(60)]
    passage = sentence(r, 25)
    for _ in range(20):
        ws = r.choice(texts[:60]).split()
        texts.append("  ".join(ws) + "\n" if r.random() < 0.5 else "\t".join(ws))
    for _ in range(25):
        ws = sentence(r, 30) + passage + sentence(r, r.randrange(20))
        texts.append(" ".join(ws))
    base = sentence(r, 300)
    for _ in range(25):
        ws = list(base)
        ws[r.randrange(300)] = "changed"
        texts.append(" ".join(ws))
    long = " ".join(sentence(r, 20_000))
    texts += ["a b " * 400, "again and " * 300 + "a b " * 20, "z " * 90, "z " * 2000]
    texts += [None, None, "", "", " ", "\n\t", "one", "one", "One", "two words", long, long + " end", "x" * 100_000]
    order = list(range(len(texts)))
    r.shuffle(order)
    return [(i * 3, texts[j]) for i, j in enumerate(order)]


EMPTY = [("doc_id long, text string, lang string, source string", [])]


def test_exact_duplicates(spark, corpus):
    got = exact_dedup.exact_duplicates(frame(spark, corpus))
    assert sorted(map(tuple, got.collect())) == sorted(plain.exact(corpus))
    for runs, fan_in in ((1, 2), (7, 2)):
        again = exact_dedup.exact_duplicates(frame(spark, corpus), runs=runs, fan_in=fan_in)
        assert sorted(map(tuple, again.collect())) == sorted(plain.exact(corpus))
    left = exact_dedup.drop_exact_duplicates(frame(spark, corpus))
    assert left.columns == frame(spark, corpus).columns
    assert sorted(x.doc_id for x in left.collect()) == sorted(x[0] for x in plain.exact(corpus) if x[3])


def test_exact_duplicates_of_repeated_rows_and_missing_keys(spark):
    rows = spark.createDataFrame([(5, "a b"), (5, "a b"), (3, "a  b"), (None, "q"), (8, None), (7, "")], "doc_id long, text string")
    got = {(x.doc_id, x.keep_id, x.group_size, x.kept) for x in exact_dedup.exact_duplicates(rows).collect()}
    assert got == {(5, 3, 3, False), (3, 3, 3, True), (None, None, 1, True), (8, 7, 2, False), (7, 7, 2, True)}


@pytest.mark.parametrize("cell_rows", [2000, 3])
def test_simhash_components(spark, corpus, monkeypatch, cell_rows):
    monkeypatch.setattr(simhash_dedup.links, "__defaults__", (cell_rows,))
    got = simhash_dedup.near_duplicates(frame(spark, corpus))
    wanted = plain.simhash(corpus)
    assert {tuple(x) for x in got.collect()} == wanted
    assert len({c for _, _, c in wanted}) < len(wanted) - 40


def test_near_duplicates_that_stay(spark, corpus):
    left = simhash_dedup.drop_near_duplicates(frame(spark, corpus))
    assert left.columns == frame(spark, corpus).columns
    assert sorted(x.doc_id for x in left.collect()) == sorted({c for _, _, c in plain.simhash(corpus)})


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4, 5])
def test_every_pair_within_the_threshold_meets_at_an_anchor(bits):
    r = np.random.default_rng(bits)
    a = r.integers(0, 1 << 63, 400, dtype=np.int64)
    b = a.copy()
    for i in range(len(b)):
        for bit in r.choice(63, bits, replace=False):
            b[i] ^= np.int64(1) << np.int64(bit)
    homes, visits = set(), set()
    for rows, anchors, home in simhash_dedup.anchor_rows(a, bits):
        homes |= set(zip(rows[home].tolist(), anchors[home].tolist(), strict=True))
    for rows, anchors, _ in simhash_dedup.anchor_rows(b, bits):
        visits |= set(zip(rows.tolist(), anchors.tolist(), strict=True))
    assert {i for i, _ in homes & visits} == set(range(400))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 500)]
    loops = [(5000, 5000), (7001, 7000), (7000, 7001)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain + star + loops, "a long, b long")).collect()}
    assert {got[n] for n in range(1, 61)} == {0} and {got[n] for n in range(1001, 1500)} == {1000}
    assert got[7001] == 7000 and 5000 not in got


@pytest.mark.parametrize(("hot", "most"), [(2000, 20_000), (4, 20_000), (4, 5)])
def test_repeated_passages(spark, corpus, monkeypatch, hot, most):
    """Cold seeds; hot seeds through the automaton; hot seeds through the join."""
    monkeypatch.setattr(phrase_dedup, "HOT_PASSAGES", hot)
    monkeypatch.setattr(phrase_dedup, "HOT_WINDOWS", most)
    monkeypatch.setattr(phrase_dedup, "SHARD_ROWS", 50)
    got = phrase_dedup.remove_repeated_passages(frame(spark, corpus))
    wanted = plain.phrases(corpus)
    assert sorted(map(tuple, got.collect())) == sorted(wanted)
    assert sum(w[2] for w in wanted) > 5000


def test_passages_without_a_shared_window_are_not_taken_apart():
    """Only passages that may hold a recurring window are split into words, numbered and streamed."""

    class Passage(bytes):
        def split(self, *args):
            taken.append(bytes(self))
            return super().split(*args)

    taken = []
    said = b"to be or not"
    shared = b"a b c d e f g h i j k l m"
    other = [said + b"".join(b" %d-%d" % (doc, i) for i in range(20)) for doc in range(50)]
    texts = [Passage(t) for t in [*other, shared, b"x\t" + shared.replace(b" ", b"\n") + b" y", shared + b" z", shared + b" z"]]
    found = list(phrase_dedup.locate(texts, [*range(50), 7, 60, 61, 61], [0] * 50 + [5, 0, 0, 30], 13))
    assert sorted(found) == [(51, 1, 14), (52, 0, 13), (53, 30, 43)]
    assert set(taken) == set(map(bytes, texts[50:]))
    assert list(phrase_dedup.locate(texts[:50], list(range(50)), [0] * 50, 13)) == []


def test_equal_passages_are_streamed_together(monkeypatch):
    """A passage that many documents have is streamed for its smallest document and for all later ones."""
    streamed = []
    covered = phrase_dedup.covered
    monkeypatch.setattr(phrase_dedup, "covered", lambda automaton, words, *a: streamed.append(words) or covered(automaton, words, *a))
    short, long = (b" ".join(b"%d" % i for i in range(n)) for n in (13, 15))
    texts, docs = [long] * 40 + [short, b"x " + short], [*range(10, 50), 3, 30]
    found = list(phrase_dedup.locate(texts, docs, [0] * 39 + [100, 0, 0], 13))
    assert sorted(found) == [(0, 0, 13), *((i, 0, 15) for i in range(1, 39)), (39, 100, 115), (41, 1, 14)]
    assert len(streamed) == 4


def test_seeds_of_windows(monkeypatch):
    """The first smallest run of every window, whatever the pieces in which words are hashed."""
    words = [f"w{i * i % 61}" for i in range(400)] + ["é" * 300, "x"] * 9
    texts = [" ".join(words), "", None, "\t \r\n".join(words[:30]), "a " * 40, " ".join(words[:12]), " ".join(words[7:20])]
    whole = phrase_dedup.window_seeds(texts)
    monkeypatch.setattr(textbytes, "PIECE", 64)
    assert all(np.array_equal(a, b) for a, b in zip(whole, phrase_dedup.window_seeds(texts), strict=True))
    _, word_at, _, first, windows, place, seeds = whole
    assert np.diff(first).tolist() == [len(plain.words(t)) for t in texts]
    assert windows.tolist() == [int(a) + j for a, n in zip(first, np.diff(first), strict=False) for j in range(n - 12)]
    runs = textbytes.rolling(textbytes.word_hashes(*whole[:3]), phrase_dedup.SEED_WORDS)
    wanted = [w + int(np.argmin(runs[w : w + 9])) for w in windows.tolist()]
    assert place.tolist() == wanted and seeds.tolist() == runs[wanted].tolist()


@pytest.mark.parametrize(("hot", "most"), [(2000, 20_000), (4, 20_000), (4, 5)])
def test_repeated_passages_with_odd_blanks(spark, monkeypatch, hot, most):
    """Equal words are one passage, however they are set apart."""
    monkeypatch.setattr(phrase_dedup, "HOT_PASSAGES", hot)
    monkeypatch.setattr(phrase_dedup, "HOT_WINDOWS", most)
    passage = [f"p{i}" for i in range(40)]
    blanks = [" ", "\t", "  ", " \n", "\x0b", "\r\n"]
    rows = [(i, f"n{i} " + blanks[i % 6].join(passage[i % 9 :]) + f" m{i} " + " ".join(passage[:20])) for i in range(30)]
    rows += [(100, None), (101, ""), (102, " ".join(passage[:12])), (103, "\u00a0".join(passage))]
    got = phrase_dedup.remove_repeated_passages(frame(spark, rows))
    assert sorted(map(tuple, got.collect())) == sorted(plain.phrases(rows))


def test_leaks(spark, corpus):
    r = random.Random(5)
    items = [(i, " ".join(sentence(r, n))) for i, n in enumerate([3, 5, 6, 20, 40, 40, 64])]
    items += [(20, None), (21, ""), (22, " ".join(["same"] * 30)), (23, "lone")]
    rows = list(corpus[:80])
    for n, (item, text) in enumerate(x for x in items if x[1]):
        ws = text.split()
        edited = [*ws]
        edited[len(ws) // 2] = "edited"
        for v, variant in enumerate((ws, edited, ws[: max(1, int(len(ws) * 0.9))], ws[1:] + ws[:1], ws[: len(ws) // 2])):
            rows.append((10_000 + n * 10 + v, " ".join(sentence(r, 30) + variant + sentence(r, 9))))
            rows.append((20_000 + n * 10 + v, "\n".join(variant)))
    about = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = {(x.doc_id, x.item_id): (x.similarity, x.first_word) for x in decontamination.leaks(frame(spark, rows), about).collect()}
    wanted = plain.leaks(rows, items)
    assert got == wanted and len(wanted) > 25
    left = decontamination.drop_contaminated(frame(spark, rows), about)
    assert sorted(x.doc_id for x in left.collect()) == sorted({i for i, _ in rows} - {i for i, _ in wanted})


def test_token_counts(spark, corpus):
    r = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "▁", "é", "😀", "　", "</s>", "<unk>", "1", "23", "\0", "ing", " hello"]
    rows = corpus + [(100_000 + i, "".join(r.choice(parts) for _ in range(r.randrange(12)))) for i in range(500)]
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    got = token_counts.token_counts(spark, frame(spark, rows), tokenizer_path(), limit=50)
    wanted = {(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 50) for i, t in rows}
    assert {tuple(x) for x in got.collect()} == wanted


def test_chat_round_trip(spark, monkeypatch):
    r = random.Random(4)
    pieces = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "[\\\\INST]", "\\", "<", "[", " ", "\n", "é", "😀", "hi", "</", "s>"]
    said = lambda: "".join(r.choice(pieces) for _ in range(r.randrange(9)))
    rows = [(c, t, r.choice(["user", "assistant", "system", "[INST]", ""]), said()) for c in range(60) for t in range(r.randrange(1, 9))]
    rows += [(77, None, None, None), (77, 1, "assistant", None), (78, 1, "assistant", "x" * 5000), (78, 0, "user", "<s>" * 900)]
    rows += [(None, 0, "user", "no key"), (79, 2, "user", "tie"), (79, 2, "assistant", "tie"), (79, 2, "assistant", "tie")]
    rows += [(80, t, "assistant", f"turn {t} ") for t in range(300)]
    table = spark.createDataFrame([(*x, "extra") for x in rows], "conv_id long, turn long, role string, text string, part string").repartition(4)
    import hashlib

    wanted = set()
    for conv in {x[0] for x in rows}:
        turns = sorted(((-1 if t is None else t, ro or "", te or "") for c, t, ro, te in rows if c == conv))
        whole = hashlib.sha256("".join(f"{ro}\n{te}\n" for _, ro, te in turns).encode()).hexdigest()
        loss = "".join(te for _, ro, te in turns if ro == "assistant")
        wanted.add((conv, len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    for most in (8 << 20, 1000):
        monkeypatch.setattr(chat_format, "PART_BYTES", most)
        formatted = chat_format.format_conversations(table)
        got = [tuple(x) for x in chat_format.read_back(formatted).collect()]
        assert {x[:5] for x in got} == wanted and len(got) == len(wanted)
        assert (max(x.part for x in formatted.collect()) > 0) == (most == 1000)
    for x in formatted.collect():
        inside = x.formatted.encode()
        assert all(b"<s>" not in inside[a:b] and b"[INST]" not in inside[a:b] for a, b in zip(x.loss_starts, x.loss_ends, strict=True))


def test_mixing_meets_the_weights(spark):
    rows = [(i, "t") for i in range(6000)]
    docs = frame(spark, rows)
    sizes = {x.source: x["count"] for x in docs.groupBy("source").count().collect()}
    mixed = mixing.mix_sources(docs, {"src0": 3.0, "src1": 1.0, "other": 4.0, "src2": 0.0}, total=8000)
    got = {x.source: x["count"] for x in mixed.groupBy("source").count().collect()}
    # The weights of sources that are not there take no share.
    assert set(got) == {"src0", "src1"} and abs(got["src0"] - 6000) < 400 and abs(got["src1"] - 2000) < 250
    per_row = mixed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("top"))
    assert per_row.where("n <> top").count() == 0
    equal = mixing.mix_sources(docs)
    assert set(sizes) == {x.source for x in equal.select("source").distinct().collect()}
    assert sorted(equal.columns) == sorted([*docs.columns, "shuffle_key"])
    assert equal.select("shuffle_key").distinct().count() == equal.count()
    again = mixing.mix_sources(docs.repartition(9))
    assert equal.select("doc_id", "copy").exceptAll(again.select("doc_id", "copy")).count() == 0


def test_nothing_gives_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "some words here")], "item_id long, text string")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    results = [
        decontamination.leaks(none, items), decontamination.leaks(frame(spark, [(1, "a b c d e f")]), items.limit(0)),
        phrase_dedup.remove_repeated_passages(none), language_id.identify(none, none),
        quality.score_quality(none, quality.fit(none, labels)), chat_format.read_back(chat_format.format_conversations(turns)),
        simhash_dedup.near_duplicates(none), exact_dedup.exact_duplicates(none), mixing.mix_sources(none), secret_scan.scan(none),
        token_counts.token_counts(spark, none, tokenizer_path()),
    ]
    for i, result in enumerate(results):
        assert result.count() == 0, i


def test_scores_do_not_depend_on_neighbours(corpus):
    r = np.random.default_rng(1)
    texts = [t for _, t in corpus if len(t or "") < 5000]
    model = quality.train(texts, [int(len(t or "") > 60) for t in texts], rounds=20)
    network = language_id.train([t or "" for t in texts], ["xy"[len(t or "") > 60] for t in texts], rounds=5)
    together = model.score(texts), language_id.label(network, texts)[1]
    for i in r.choice(len(texts), 30, replace=False):
        assert abs(model.score([texts[i]])[0] - together[0][i]) < 1e-4
        assert abs(language_id.label(network, [texts[i]])[1][0] - together[1][i]) < 1e-4


def test_texts_without_labels(spark):
    docs = frame(spark, [(1, "abc"), (2, None), (3, "")])
    nothing = language_id.identify(docs, docs.limit(0))
    assert {tuple(x) for x in nothing.collect()} == {(i, "und", 0.0) for i in (1, 2, 3)}
    scored = quality.score_quality(docs, None)
    assert {tuple(x) for x in scored.collect()} == {(i, 1.0, 1) for i in (1, 2, 3)}


def test_secret_scan_of_issued_keys(spark):
    r = random.Random(6)
    rows = []
    for i in range(300):
        ws = sentence(r, 30)
        if i % 3 == 0:
            ws[10] = "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
        elif i % 3 == 1:
            ws[10] = "".join(r.choice("0123456789") for _ in range(16))
        else:
            ws[10:13] = ["token", "=", '"' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"']
        rows.append((i, " ".join(ws)))
    rows += [(900, None), (901, ""), (902, "x1" * 50_000)]
    got = secret_scan.scan(frame(spark, rows)).collect()
    by_doc = {x.doc_id: x for x in got}
    assert set(by_doc) == {*range(300), 902}
    right = [by_doc[i].secret == (i % 3 != 1) for i in range(300)]
    assert sum(right) >= 297
    assert by_doc[0].word_at == 10 and by_doc[2].word_at == 12 and by_doc[1].candidate == rows[1][1].split()[10]
