import random
import zlib

from rankvane.llm import toxicity as T


def corpus(n=1200):
    rng = random.Random(6)
    vocab = {"en": [f"word{i}" for i in range(300)], "de": [f"wort{i}" for i in range(300)]}
    bad = {"en": ["grumble", "snarl"], "de": ["murr", "knurr"]}
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        words = rng.choices(vocab[lang], k=rng.randint(5, 120))
        toxic = rng.random() < 0.2
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad[lang])
        rows.append((i, " ".join(words), lang, int(toxic)))
    return rows


def test_held_out_accuracy_and_thresholds(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    model, thresholds = T.train(docs, labels)
    assert set(thresholds) == {"en", "de"}
    score = {r["doc_id"]: r["score"] for r in T.score_documents(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    right = sum((score[r[0]] >= T.DEFAULT_THRESHOLD) == bool(r[3]) for r in held)
    assert right / len(held) > 0.95
    kept = {r["doc_id"] for r in T.keep_clean(docs, labels).collect()}
    assert sum(r[0] in kept for r in held if not r[3]) > 0.95 * sum(not r[3] for r in held)


def test_a_score_does_not_depend_on_its_neighbours(spark):
    rows = corpus(300)
    model = T.TextCnn(T.Params())
    buckets = T.Buckets(model.p.buckets)
    docs = [T.word_rows(r[1], buckets) for r in rows] + [T.word_rows("", buckets)]
    together = model.scores(docs)
    assert max(abs(together - [model.scores([d])[0] for d in docs])) < 1e-6


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, None, None), (None, "x", "en"), (1, "", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.keep_clean(docs, labels).count() == 3
    assert {r["score"] for r in T.toxic_documents(docs, labels).collect()} == {0.5}


def test_thresholds_cover_all_labelled_rows(spark):
    """A language with few clean rows among thousands has its own, and the mix of classes is the real one."""
    rng = random.Random(7)
    rows = []
    for i in range(16000):
        lang = "de" if i % 40 == 0 else "en"
        toxic = rng.random() < (0.5 if lang == "de" else 0.11)
        words = rng.choices([f"word{k}" for k in range(50)], k=6) + rng.choices(["snarl", "grumble", "hiss"], k=rng.choice([1, 2, 3] if toxic else [0, 0, 0, 1, 2]))
        rows.append((i, " ".join(words), lang, int(toxic)))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    model, thresholds = T.train(docs, labels)
    assert set(thresholds) == {"en", "de"}
    buckets = T.Buckets(model.p.buckets)
    for lang in ("en", "de"):
        own = [r for r in rows if r[2] == lang and zlib.crc32(str(r[0]).encode()) % 4 == 3]
        score, truth = model.scores([T.word_rows(r[1], buckets) for r in own]), [r[3] for r in own]

        def f1(at):
            hit = score >= at
            return 2 * sum(t for h, t in zip(hit, truth) if h) / (sum(hit) + sum(truth))

        assert f1(thresholds[lang]) >= max(map(f1, T.STEPS)) - 0.002


def test_scores_as_a_plain_forward_pass():
    """Every filter slid over every text, one window at a time."""
    import numpy as np

    rows = corpus(60)
    p = T.Params(buckets=512, dims=4, filters=4, epochs=1)
    buckets = T.Buckets(p.buckets)
    docs = [T.word_rows(r[1], buckets) for r in rows] + [T.word_rows(t, buckets) for t in ("", "one", "one two")]
    model = T.TextCnn(p).fit(docs, np.array([r[3] for r in rows] + [0, 0, 1], np.float32))
    want = []
    for d in docs:
        x = np.concatenate([model.e[d], np.zeros((max(p.widths), p.dims))])  # the space behind a text
        h = []
        for w, f, b in zip(p.widths, model.w, model.b):
            h += [max(0, max(float(row @ x[i : i + w].ravel()) for i in range(len(x) - w + 1)) + float(c)) for row, c in zip(f, b)]
        want.append(1 / (1 + np.exp(-(np.dot(h, model.v) + model.c + model.shift))))
    assert np.allclose(model.scores(docs), want, atol=1e-5)
    assert model.e[0].any() == False  # noqa: E712


def test_the_gradient_lowers_the_loss():
    import numpy as np

    rows = corpus(400)
    p = T.Params(epochs=3)
    buckets = T.Buckets(p.buckets)
    docs, y = [T.word_rows(r[1], buckets) for r in rows], np.array([r[3] for r in rows], np.float32)

    def loss(model):
        s = np.clip(model.scores(docs), 1e-9, 1 - 1e-9)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    assert loss(T.TextCnn(p).fit(docs, y)) < 0.5 * loss(T.TextCnn(p))


def test_rows_of_labels_that_teach_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en") for i in range(20)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(None, 0), (3, None)], "doc_id long, toxic int")
    assert T.keep_clean(docs, labels).count() == 20
