import re
from html import unescape

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assay.llm import ann, html_text, labelled, language_id, quality, toxicity

SF = "/root/testdata/sf0.01"


def held(spark, out, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = out.filter("held_out").join(labels, "doc_id").select(label, "score", "predicted").collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_language(spark, edges, no_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language_id.op7(spark, SF)
    assert out.count() == docs.count()
    got = out.filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").select((F.col("lang") == F.col("lang_pred")).cast("int"), "rejected").collect()
    assert np.mean([r[0] for r in got]) > 0.98 and np.mean([r[1] for r in got]) < 0.01
    model = language_id.fit(docs)
    rows = {r["doc_id"]: r for r in language_id.predict(edges.select("doc_id", "text"), model).collect()}
    for i in (1, 2, 3, 11):
        assert rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 and rows[i]["rejected"]
    assert rows[10]["lang_pred"] in model.langs and 0 < rows[10]["score"] <= 1
    kept = language_id.accepted(edges, model)
    assert kept.columns == edges.columns and {1, 2, 3, 11}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert language_id.fit(no_rows) is None
    assert language_id.predict(edges.select("doc_id", "text"), None).filter("lang_pred <> 'und'").count() == 0
    assert language_id.accepted(no_rows, model).count() == 0


def test_prediction_does_not_read_other_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    a = language_id.predict(docs.select("doc_id", "text"), model).orderBy("doc_id").select("lang_pred", "score").collect()
    b = language_id.predict(docs.select((-F.col("doc_id")).alias("doc_id"), "text"), model).orderBy(F.desc("doc_id")).select("lang_pred", "score").collect()
    assert a == b


def test_toxicity(spark, edges, no_rows):
    y, s, _ = held(spark, toxicity.op8(spark, SF), "toxic")
    assert auc(y, s) > 0.8
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    rows = [r["score"] for r in toxicity.score(edges, model).collect()]
    assert len(rows) == edges.count() and all(0 <= x <= 1 for x in rows)
    assert toxicity.score(no_rows, model).count() == 0
    one = toxicity.fit(edges, labels.filter("toxic = 0"))
    assert all(r["score"] < 1e-9 for r in toxicity.score(edges, one).collect())


def test_toxic_counts():
    r = toxicity.log_count_ratios(np.array([9.0, 1.0]), np.array([1.0, 9.0]), 10, 10)
    assert r[0] > 0 and abs(r[0] + r[1]) < 1e-12
    data = np.frombuffer(b"abcdxabcd", np.uint8)
    doc, _ = toxicity.present(data, np.array([0, 4, 5, 9]), None)
    assert np.bincount(doc, minlength=3).tolist() == [3, 0, 3]  # abc, bcd, abcd; nothing crosses texts


def test_quality(spark, edges, no_rows):
    y, s, p = held(spark, quality.op9(spark, SF), "quality")
    assert (y == p).mean() > 0.95 and auc(y, s) > 0.97
    trees = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r["score"] for r in quality.score(edges, trees).collect()]
    assert len(rows) == edges.count() and all(0 <= x <= 1 for x in rows)
    assert quality.score(no_rows, trees).count() == 0
    none = quality.grow(np.zeros((0, len(quality.STATISTICS))), np.zeros(0))
    assert none.scores(np.zeros((2, len(quality.STATISTICS)))).max() < 1e-9


def test_trees_walk_like_plain_code():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    t = quality.grow(x, y)
    assert ((t.scores(x) > 0.5) == y).mean() > 0.97
    for row in x[:20]:
        z = t.base
        for node in t.root:
            while t.left[node] != node:
                node = t.left[node] if row[t.feature[node]] <= t.threshold[node] else t.right[node]
            z += t.value[node]
        assert abs(1 / (1 + np.exp(-z)) - t.scores(row[None])[0]) < 1e-9


def test_statistics_do_not_cross_texts():
    a, b = b"One two two.\nOne two two.\n", b"x | y | z!"
    both = quality.statistics(np.frombuffer(a + b, np.uint8), np.array([0, len(a), len(a), len(a) + len(b)]))
    for i, t in enumerate((a, b"", b)):
        assert np.allclose(both[i if i < 2 else 2], quality.statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0])


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    model = html_text.fit(pages, composed_pages=300)
    good = 0
    for r, x in zip(html_text.extract(pages, model).orderBy("page_id").collect(), pages.orderBy("page_id").collect(), strict=True):
        article = re.search(r"<article>(.*?)</article>", x["html"], re.S)[1]
        want = [" ".join(unescape(re.sub(r"<[^>]*>", "", t)).split()) for t in re.split(r"</?(?:h1|p|br)\b[^>]*>", article)]
        good += r["text"] == " ".join(t for t in want if t) and r["n_chars"] == len(r["text"])
    assert good >= 0.98 * pages.count()
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>"), (4, "u", "just a line of plain text that is long enough to be read as one"), (4, "u", "<article><p>a&amp;b <b>c</b>d</p></article>"),
            (5, "u", "<div class=menu><a>x</a></div><main><h1>T</h1><p>Body of it, with words.</p></main><div class='comments'><p>Nice!</p></div><!-- x")]
    got = sorted((r["page_id"], r["text"]) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect())
    assert got[:3] == [(1, ""), (2, ""), (3, "")] and (4, "a&b cd") in got and got[-1] == (5, "T Body of it, with words.")
    assert html_text.extract(pages.limit(0), model).count() == 0
    assert html_text.fit(pages.limit(0), composed_pages=20) is not None


def test_blocks():
    b = html_text.blocks_of("<ul><li>a<li>b</ul><p>x <a href='#'>y</a>\n z<br>w<p>v<script>if (a<b) '</p>'</script>&lt;<table><tr><td>1<td>2</table>")
    assert [x.text for x in b] == ["a", "b", "x y z", "w", "v<", "1", "2"]
    assert [x.path for x in b][:3] == [("ul", "li"), ("ul", "li"), ("p",)] and b[2].linked == 1


def test_lstm_gradients():
    rng = np.random.default_rng(2)
    pages = [html_text.composed(["a", "bb", "c."], rng) for _ in range(2)]
    m = html_text.Labeller()
    x = html_text.inputs([b for bs, _ in pages for b in bs])
    at = np.concatenate([[0], np.cumsum([len(b) for b, _ in pages])])
    y = np.array([v for _, ys in pages for v in ys], float)
    _, g = m.gradients(x, at, y)
    for k in m.p:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = m.p[k][i]
        m.p[k][i] = old + 1e-5
        up = m.gradients(x, at, y)[0]
        m.p[k][i] = old - 1e-5
        down = m.gradients(x, at, y)[0]
        m.p[k][i] = old
        assert abs((up - down) / 2e-5 - g[k][i]) < 1e-4 * max(1, abs(g[k][i])), k


def neighbours(rows, k=20):
    """Brute force over (vec_id, vector): for each query row its (score, vec_id), best first."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)).tolist() if j != i][:k]
        out.append((int(ids[i]), [(float(s[j]), int(ids[j])) for j in order]))
    return out


def by_query(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    return {q: sorted(v) for q, v in got.items()}


@pytest.mark.parametrize("how", [{}, {"block": 60, "chunk": 7}])
def test_neighbours(spark, how):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    odd = [(1_000_000, None), (1_000_020, [0.0] * 64), (1_000_040, [float("nan")] + [1.0] * 63), (1_000_060, [None] + [1.0] * 63), (1_000_080, [1.0]), (1_000_100, [float("inf")] + [1.0] * 63)]
    got = by_query(ann.search(v.union(spark.createDataFrame(odd, "vec_id long, embedding array<float>")), F.col("vec_id") % 20 == 0, **how))
    rows = [(r["vec_id"], r["embedding"]) for r in v.collect()]
    score = dict(rows)
    want = dict(neighbours(rows))
    assert set(got) == set(want)
    hit = 0
    for q, found in got.items():
        assert [r[0] for r in found] == list(range(1, 21)) and q not in [r[2] for r in found]
        assert all(abs(np.dot(np.array(score[q], float), np.array(score[i], float)) - s) < 1e-12 for _, s, i in found)
        assert [(-r[1], r[2]) for r in found] == sorted((-r[1], r[2]) for r in found)
        hit += len({i for _, i in want[q]} & {r[2] for r in found})
    assert hit >= 0.9 * 20 * len(got)


@pytest.mark.parametrize("how", [{}, {"block": 100, "chunk": 16}])
def test_equal_vectors(spark, how):
    """A thousand equal vectors, some more in equal pairs, and two rows of one vec_id: every row but the query's own, ties to smaller ids."""
    rng = np.random.default_rng(4)
    one = rng.normal(size=8)
    rows = [(i, one.tolist()) for i in range(1000)] + [(1000 + i, (one * (1 + i // 2)).tolist()) for i in range(30)] + [(20, one.tolist()), (40, (one * 2).tolist())]
    got = by_query(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, share=1.0, **how))
    want = {}
    for q, found in neighbours(rows):
        want[q] = sorted(want.get(q, []) + [(rank, round(s, 9), i) for rank, (s, i) in enumerate(found, 1)])
    assert {q: [(r, round(s, 9), i) for r, s, i in v] for q, v in got.items()} == want


def test_best_estimates_keep_ties():
    assert ann.best_of(np.array([1.0, 3, 2, 2, 2, 0]), 2).tolist() == [1, 2, 3, 4]
    assert ann.best_of(np.array([1.0, 2]), 5).tolist() == [0, 1]


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall(spark, sf):
    v = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").select("vec_id", "embedding")
    got = by_query(ann.search(v, F.col("vec_id") % 20 == 0))
    want = neighbours([(r["vec_id"], r["embedding"]) for r in v.collect()])
    hit = sum(len({i for _, i in found} & {r[2] for r in got[q]}) for q, found in want)
    assert hit >= 0.9 * 20 * len(want)


def rows_of(kind, n=3000, d=48):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, d))
    if kind == "lengths":  # the nearest are long vectors of any list
        x *= rng.lognormal(0, 1.5, (n, 1))
    elif kind == "shifted":  # a common direction, and products that differ little
        x = 10 * x[0] + 0.01 * x
    elif kind == "tails":
        x = rng.standard_cauchy((n, d))
    elif kind == "copies":  # near copies of a few vectors
        x = x[rng.integers(0, 7, n)] + 1e-3 * x
    elif kind == "sparse":
        x *= rng.random((n, d)) < 0.05
        x[:, 0] += 1e-3
    elif kind == "opposed":  # queries look away from all other rows
        x = np.abs(x)
        x[::20] *= -1
    return x


@pytest.mark.parametrize("kind", ["lengths", "shifted", "tails", "copies", "sparse", "opposed"])
def test_nearest_of_other_rows(spark, kind):
    rows = [(i, v.tolist()) for i, v in enumerate(rows_of(kind))]
    got = by_query(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), F.col("vec_id") % 20 == 0))
    want = neighbours(rows)
    assert set(got) == {q for q, _ in want}
    lost = {q: [s for s, i in found if i not in {r[2] for r in got[q]}] for q, found in want}
    found = 1 - sum(map(len, lost.values())) / (20 * len(want))
    assert found == 1, (kind, found)


def test_few_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(v, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 3), (0, 2, 20), (20, 1, 3), (20, 2, 0)]
    assert ann.search(v.limit(0), F.col("vec_id") % 20 == 0).count() == 0


#: Texts in languages that no table holds.
FOREIGN = [
    "La città era ancora avvolta nella nebbia quando il primo treno della mattina lasciò la stazione centrale.",
    "O velho pescador acordou antes do amanhecer e caminhou até a praia, onde o seu barco estava à espera.",
    "De oude man liep langzaam door het park terwijl zijn hond vrolijk achter de vogels aan rende.",
    "Wczoraj wieczorem poszliśmy do kina, żeby obejrzeć nowy film, o którym wszyscy mówili.",
    "Det var en gång en liten flicka som bodde i ett rött hus vid skogen.",
    "Kesällä järven rannalla on hiljaista, kun aurinko laskee vasta myöhään illalla.",
    "Sabah erkenden uyandık ve kahvaltıdan sonra eski şehrin dar sokaklarında yürüyüşe çıktık.",
    "Setiap pagi ibu saya pergi ke pasar untuk membeli sayuran segar dan ikan.",
    "Вчера вечером мы долго гуляли по набережной и разговаривали о том, как изменился наш город.",
    "昨天下午我和朋友一起去公园散步，天气很好，很多人在湖边钓鱼。",
    "ذهبت أمس إلى السوق مع أخي واشترينا بعض الفواكه والخضروات الطازجة ثم عدنا إلى البيت.",
    "Χθες το βράδυ πήγαμε για φαγητό σε μια μικρή ταβέρνα δίπλα στη θάλασσα.",
    "어제 저녁에 친구들과 함께 새로 생긴 식당에 가서 맛있는 음식을 많이 먹었습니다.",
    "कल शाम हम सब दोस्त मिलकर नदी के किनारे घूमने गए और वहाँ बहुत देर तक बातें करते रहे।",
]
JUNK = ["asdf jkl; qwer uiop zxcv", "xkcd qqq zzz wwwww vvv", "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQ=", "d41d8cd98f00b204e9800998ecf8427e 5d41402abc4b2a76b9719d911017c592", "kjshdf kjhsdf kjhsdf kjhwef", "qzx vbnk wqpl kjhg zzxcv bnmq", "hjkl yuiop vbnm ghjk rtyu"]


def judged(model, texts):
    raw = [t.encode() for t in texts]
    return language_id.judged(model, pa.array(texts), np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))


def test_rejection(spark):
    """Unlearned languages and junk go, clean documents that were not learned from stay, short ones too."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language_id.fit(docs)
    assert np.mean(judged(model, FOREIGN)[2]) >= 0.9 and np.mean(judged(model, JUNK)[2]) >= 0.9
    kept_out = [r["text"] for r in docs.filter((language_id.crc_mod(4) == 2) & F.col("text").rlike("[A-Za-z]")).select("text").collect()]
    short = [t for t in kept_out if len(t) < 120]
    assert len(kept_out) > 2000 and np.mean(judged(model, kept_out)[2]) <= 0.005
    assert len(short) > 50 and np.mean(judged(model, short)[2]) <= 0.03
    for left_out, least in (("de", 0.9), ("en", 0.8)):  # a language of the table that the model has not seen; en is most of the table
        other = language_id.fit(docs.filter(F.col("lang") != left_out))
        assert left_out not in other.langs
        unseen = [r["text"] for r in docs.filter((F.col("lang") == left_out) & (F.col("doc_id") % 5 == 0)).collect()]
        assert np.mean(judged(other, [t for t in unseen if t])[2]) >= least, (left_out, other.threshold)


def test_language_scores_by_hand(spark):
    """Scores of single texts by plain Python over their n-grams."""
    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    texts = ["Der Hund.", "x", "  --ab  c\n\td!! ÉÀ", "the" * 50, "é", "A1b2", FOREIGN[0], "漢字", "one", ""]
    lang, score, out = judged(model, texts)
    for t, y, s, bad in zip(texts, lang, score, out, strict=True):
        raw = bytearray(t.encode())
        for i, c in enumerate(raw):
            if i and raw[i - 1] == 0xC3 and 0x80 <= c <= 0x9E and c != 0x97:
                raw[i] = c + 32
            elif c < 128:
                raw[i] = c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32
        b = b" " + b" ".join(bytes(raw).split(b" ")) + b" "
        b = re.sub(rb" +", b" ", b)
        grams = [b[i : i + k] for k in (2, 3, 4) for i in range(len(b) - k + 1)]
        if not any(ch.isalpha() for ch in t):
            assert (y, s, bad) == ("und", 0.0, True)
            continue
        rows = []
        for g in grams:
            h = (int.from_bytes(g, "little") * 2654435761 + (len(g) - 1) * 40503) & 0xFFFFFFFF
            rows.append(model.scores[((h ^ (h >> 15)) * 2246822519 & 0xFFFFFFFF) >> (32 - language_id.BITS)])
        at = int(np.searchsorted(language_id.LENGTHS, len({g for g in grams if len(g) == 4})))
        z = (np.mean(np.array(rows, float), axis=0) + model.bias) / model.temperature[at]
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert y == model.langs[int(p[:-1].argmax())] and abs(s - p[:-1].max()) < 1e-6 and bad == (p[-1] > model.threshold[at])


def test_language_learns_from_whole_texts():
    words = ["w" + "".join(chr(97 + int(c)) for c in str(i)) for i in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(words), "ab"]), pa.array(["en", "de"])], names=["text", "lang"])
    got = next(language_id._examples([batch])).to_pylist()
    whole = [r for r in got if not r["cut"]]
    assert [r["lang"] for r in whole] == ["en", "de"] and whole[0]["distinct"] == language_id.bag(" ".join(words))[1] > 500
    assert [r["lang"] for r in got].count(None) >= 2


def test_samples_are_bounded_by_rows(spark):
    """A doc_id or a text of very many rows does not make a sample longer."""
    rows = spark.range(4000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 2000).cast("string")).alias("text"), F.lit("en").alias("lang"))
    n = labelled.stored_sample(rows, 400, "t").count()
    assert 0 < n < 800
    one = rows.withColumn("text", F.lit("same"))
    assert labelled.stored_sample(one, 400, "t").count() <= 1
    labels = spark.createDataFrame([(5, 1)], "doc_id long, toxic int")
    assert labelled.labelled_texts(rows, labels, "toxic", 5, 9, 400).count() < 800


def test_toxic_scores_by_hand(spark):
    """Scores and predictions of whole texts by plain Python over their distinct n-grams; found and missed documents."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    for t in ("", "abc", "You stupid   IDIOT\tyou", "é漢" * 4, "worthless scum and trash", docs.filter("doc_id = 7").first()["text"]):
        raw = bytes(c + 32 if 65 <= c <= 90 else 32 if c in b"\t\n\r\x0b\x0c" else c for c in t.encode())
        found = set()
        for k in toxicity.ORDERS:
            for i in range(len(raw) - k + 1):
                h = (int.from_bytes(raw[i : i + k], "little") + k - 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
                found.add(((h ^ h >> 29) >> 8 & 0xFFFFFFFF) & ((1 << toxicity.BITS) - 1))
        z = model.bias + sum(model.weight[b] for b in found if model.keep[b])
        data = np.frombuffer(t.encode(), np.uint8)
        assert abs(model.scores(data, np.array([0, len(data)]))[0] - 1 / (1 + np.exp(-z))) < 1e-9
    out = toxicity.score(docs, model).select("doc_id", (toxicity.crc_mod(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    rows = out.filter("held_out").join(labels, "doc_id").select("toxic", "score", "predicted").collect()
    y, s, p = (np.array([r[i] for r in rows]) for i in range(3))
    assert ((s >= 0.5) == p).all() and p[y == 1].mean() >= 0.8 and p[y == 0].mean() <= 0.02


def test_statistics_by_hand():
    """Document statistics by plain Python."""
    for t in ("", "One two two.", "a | b | c!\nA b.\n\nx", "Wort für Wort, 12 [x]; y? Z", "same same same\nsame same same\n", "   ", "antidisestablishmentarianism it"):
        raw = t.encode()
        words = raw.split()
        low = [w.lower() for w in words]  # bytes.lower folds A-Z only
        lines = [x for x in re.split(rb"(?<=\n)", raw) if x]
        n, w = len(raw), len(words)
        size = np.array([len(x) for x in words], float)
        pairs = list(zip(low, low[1:], strict=False))
        kind = lambda chars: sum(c in chars for c in raw)
        marks = b"#$%&*+=@^_~\\/"
        want = {
            "log_bytes": np.log1p(n), "log_words": np.log1p(w), "share_upper": sum(65 <= c <= 90 for c in raw) / max(n, 1), "share_wide": sum(c > 127 for c in raw) / max(n, 1),
            "word_length": size.mean() if w else 0, "word_spread": size.std() if w else 0, "short_words": (size <= 3).mean() if w else 0, "long_words": (size >= 14).mean() if w else 0,
            "distinct_words": len(set(low)) / w if w else 0, "top_word": max(map(low.count, low)) / w if w else 0,
            "word_repeats": np.mean([a == b for a, b in pairs]) if pairs else 0, "distinct_pairs": len(set(pairs)) / len(pairs) if pairs else 0,
            "words_a_line": np.log1p(w / len(lines)) if w else 0, "distinct_lines": len(set(lines)) / len(lines) if w else 0, "short_lines": np.mean([len(x) < 30 for x in lines]) if w else 0,
            "stops_a_word": kind(b".?") / max(w, 1), "marks_a_word": kind(marks) / max(w, 1),
        }
        got = quality.statistics(np.frombuffer(raw, np.uint8), np.array([0, n]))[0]
        for name, v in want.items():
            assert abs(got[quality.STATISTICS.index(name)] - v) < 1e-9, (t, name)


def test_toxicity_keeps_every_telling_feature(spark):
    rng = np.random.default_rng(6)
    bad, good = (["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 12)) for _ in range(500)] for _ in range(2))
    rows = [(i, " ".join(rng.choice(bad if i % 2 else good, 150, replace=False)), i % 2) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    assert model.keep.sum() > 6000


def test_icons_do_not_swallow_the_page():
    icon = '<svg viewBox="0 0 1 1" class="i"/>'
    assert [b.text for b in html_text.blocks_of(f"<p>{icon}before</p><p>after</p><svg><text>drawn</text></svg><p>end</p>")] == ["before", "after", "end"]
    for tag in ("svg", "iframe", "template", "noscript"):
        assert [b.text for b in html_text.blocks_of(f"<p>a</p><{tag} x='1'><p>b</p><p>c</p>")] == ["a", "b", "c"]
        assert [b.text for b in html_text.blocks_of(f"<p>a</p><{tag} x='1'>no</{tag.upper()} ><p>c</p>")] == ["a", "c"]
    assert [b.text for b in html_text.blocks_of("<p>a</p><script>if (b) <p>c</p>")] == ["a"]


def test_scanning_pages_is_linear():
    import time

    for bad in ("<a ", "<a href=\"x ", "<!--", "<script ", "<svg>", "<div>", "<p><div></p>", "</p>", "<a title='", "<li>", "<![", "<b><i>", "&amp;<"):
        start = time.time()
        html_text.blocks_of(bad * (1_000_000 // len(bad)))
        assert time.time() - start < 6, bad
    start = time.time()
    assert html_text.blocks_of("<a " * 333_333) == [] and time.time() - start < 1


def test_broken_and_hidden_markup():
    text = lambda page: [b.text for b in html_text.blocks_of(page)]
    assert text('<p><a href="x>link</a> end</p><p>next</p>') == ["link end", "next"]
    assert text('<p><a title="a > b" href=y>link</a></p>') == ["link"]
    assert html_text.blocks_of("<p><a href=/x/>link</a> end")[0].linked == 4
    assert text("<p>a</p><div hidden><p>b</p></div><p>c</p>") == ["a", "c"]
    assert text("<p>a</p><div style='color:red; display: none'>b<p>c</p></div>d<span style=display:none>e</span>f") == ["a", "df"]
    assert text("<p class='hidden-xs' data-hidden='1'>a</p><p aria-hidden='false'>b</p>") == ["a", "b"]
    assert html_text.blocks_of("<div class='userComments pageFooter XMLBody2'>x</div>")[0].path == ("div", ".user", ".comments", ".page", ".footer", ".xml", ".body", ".2")


def test_pages_of_other_sites(spark):
    """Camel case, opaque class names and elements that tell nothing."""
    model = html_text.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    words = "the storm moved over the hills and the village waited for the rain that everybody had hoped for since the spring ".split()
    body = [" ".join(words[i:] + words[:i]) + "." for i in (0, 3, 7, 11)]
    paragraphs = "".join(f"<p>{b}</p>" for b in body)
    nav = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("Home", "News", "Contact", "Search"))
    pages = [
        f"<div class='siteNav'><ul>{nav}</ul></div><div class='postBody'>{paragraphs}</div><div class='userComments'><div>Great post, thanks!</div><div>Reply</div></div><div class='pageFooter'>Copyright 2024. All rights reserved.</div>",
        f"<div class='q1'><ul>{nav}</ul></div><div class='q2'>{paragraphs}</div><div class='q3'><div>Great post, thanks for sharing!</div><div>Reply</div></div><div class='q4'>Copyright 2024 Example Ltd. All rights reserved.</div>",
        f"<div><ul>{nav}</ul></div><div>{paragraphs}</div><div>Share on Facebook</div><div>Privacy policy</div><div>Copyright 2024</div>",
    ]
    rows = spark.createDataFrame([(i, None, h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    for r in html_text.extract(rows, model).collect():
        assert r["text"] == " ".join(body), (r["page_id"], r["text"])


def test_labels_by_hand():
    """The bidirectional pass over pages of different lengths, by plain Python over one page at a time."""
    rng = np.random.default_rng(3)
    pages = [html_text.composed(["a", "bb", "c."], rng)[0] for _ in range(5)] + [[html_text.Block("x", (), 0)], []]
    m = html_text.Labeller()
    x = html_text.inputs([b for bs in pages for b in bs])
    at = np.concatenate([[0], np.cumsum([len(b) for b in pages])])
    got = m.probabilities(x, at)
    sig = lambda z: 1 / (1 + np.exp(-z))
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        v = m.vectors(x)[lo:hi]
        states = {}
        for way, steps in (("f", range(hi - lo)), ("b", range(hi - lo - 1, -1, -1))):
            h, c = np.zeros(html_text.HIDDEN), np.zeros(html_text.HIDDEN)
            for t in steps:
                f, i, o, g = np.split(v[t] @ m.p["x" + way] + m.p["c" + way] + h @ m.p["h" + way], 4)
                c = sig(f) * c + sig(i) * np.tanh(g)
                h = sig(o) * np.tanh(c)
                states[way, t] = h
        for t in range(hi - lo):
            z = np.concatenate([states["f", t], states["b", t], v[t]]) @ m.p["out"] + m.p["bias"][0]
            assert abs(got[lo + t] - sig(z)) < 1e-9
