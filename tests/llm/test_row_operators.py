import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from regista.llm import mil_classifier, pii, quality_rules, sharding, topk

DOC = "doc_id long, text string, lang string"


def base_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_measure_by_hand(spark, sf):
    texts = ["", None, " ", "a b c", "x " * 50, "a\nb\na\n\n \n", "é | # $ < > x", "one two three four five six seven eight nine " * 3, "tab\x0bvt\x0cff\x1cfs"]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for t in texts:
        assert quality_rules.measure(t or "")[:5] == base_by_hand(t)


def test_quality_rules_rows(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    extra = spark.createDataFrame([(None, None, "en"), (0, "", "en")], DOC)
    rows = docs.select("doc_id", "text", "lang").unionByName(extra)
    got = quality_rules.judge(rows, labels).collect()
    assert len(got) == rows.count()
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(quality[r.doc_id], r.kept) for r in got if r.doc_id in quality and not r.base_failed]
    clean = [k for q, k in judged if q == 1]
    assert sum(clean) >= 0.97 * len(clean)
    kept = quality_rules.keep_good(rows.withColumn("kept", rows.lang), labels)
    assert kept.columns == ["doc_id", "text", "lang", "kept"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((r.doc_id is None, r.doc_id or 0) for r in got if r.kept)
    assert quality_rules.judge(rows.where("false"), labels.where("false")).count() == 0


def path_by_hand(tree, x, height):
    """Length of one row's path through a tree, by walking it."""
    feature, split, left, right, path = tree
    node, steps = 0, 0
    while feature[node] >= 0:
        node = left[node] if x[feature[node]] < split[node] else right[node]
        steps += 1
    assert steps <= height and path[node] >= steps
    return path[node]


def test_verdicts_by_hand(spark, sf):
    """Scores from paths walked one by one, and the threshold that gains most on the labelled rows, tried one by one."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rated, forest, threshold = quality_rules.fit(docs, labels)
    rows = rated.collect()
    quality = {r.doc_id: r.quality for r in labels.orderBy("quality", ascending=False).collect()}
    junk, clean = [], []
    for r in rows:
        x = quality_rules.features(np.array([[r[c] for c in quality_rules.STATS]]))[0]
        if r.doc_id % 20 == 0:
            mean = np.mean([path_by_hand(t, x, forest.height) for t in forest.trees])
            assert abs(r.anomaly - 2 ** (-mean / forest.norm)) < 1e-9
        if not r.base_failed and r.doc_id in quality:
            (clean if quality[r.doc_id] > 0 else junk).append(r.anomaly)
    gain = lambda t: np.mean([a >= t for a in junk]) - 10 * np.mean([a >= t for a in clean])
    best = max(gain(k / quality_rules.BINS) for k in range(quality_rules.BINS + 1))
    assert junk and clean and abs(gain(threshold) - best) < 1e-9
    verdict = {r.doc_id: r.kept for r in quality_rules.judge(docs, labels).collect()}
    assert verdict == {r.doc_id: not r.base_failed and r.anomaly < threshold for r in rows}


def test_repeated_rows_do_not_fill_the_sample(spark):
    rows = [(1, "the same text over and over again with more than twenty words in it so that it passes the base rule for length easily")] * 300
    rows += [(i, " ".join(f"w{j % (i % 40 + 20)}x{i}" for j in range(60))) for i in range(2, 60)]
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    _, forest, _ = quality_rules.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, trees=10, tree_rows=8)
    assert sum((t[0] >= 0).any() for t in forest.trees) == 10


def test_isolation_orders_outliers():
    draw = np.random.default_rng(0)
    rows = np.concatenate([draw.normal(size=(2000, 3)), [[9.0, 9, 9]]])
    score = quality_rules.Forest(rows, 50, 256, 1).score(rows)
    assert score[-1] == score.max() > 0.65 and np.median(score) < 0.5


def test_surrogates_keep_type_and_differ():
    text = 'Mail Hein.19@Mail5.example.com, +1 (743) 555-3824 or 743-555-3824, 4111 1111 1111 1111, 10.1.2.3, token = "24be64439e3e49cf", DE89 3704 0044 0532 0130 00, Dr. Mary Smith. SMITH left. Господин Иван Петров.'
    new, found = pii.replace(text, b"k")
    assert [k for _, _, k, _ in found] == ["email", "phone", "phone", "card", "ip", "secret", "iban", "given_f", "name", "name", "given_M", "name"]
    for a, b, _, _ in found:
        assert text[a:b] not in new
    assert re.match(r"Mail [A-Z][a-z]{3}\.\d\d@[A-Z][a-z]{3}\d\.example\.com,", new)
    assert pii.luhn(re.search(r"(?:\d{4} ){3}\d{4}", new)[0].replace(" ", "")) == 0
    iban = re.search(r"DE\d\d(?: \d{4}){4} \d\d", new)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    phones = re.findall(r"\(?(\d{3})\)?[ -](\d{3}-\d{4})", new)
    assert phones[0] == phones[1]
    family = re.search(r"Dr\. (\w+) (\w+)\. (\w+) left", new)
    assert family[1] in pii.GIVEN["f"] and family[2].upper() == family[3]
    russian = re.search(r"Господин ([А-Яа-яё]+) ([А-Яа-яё]+)\.", new)
    assert russian[1] in pii.GIVEN["M"] and russian[2].endswith("ов")


@pytest.mark.parametrize("text", ["(Mr Smith)", '"James Miller" said', "author:Anna Weber", '{"name":"Anna Weber"}', "[Dr. Smith]", "—Анна Петрова—", "Mr. J. R. Smith", "MR SMITH", "my name is Zoë Quinn", "Kind regards,\nTilda Hund"])
def test_names_beside_punctuation(text):
    new, found = pii.replace(text, b"k")
    assert found[-1][2] == "name"
    assert not {text[a:b] for a, b, _, _ in found} & set(re.findall(r"\w+", new))


def test_given_name_alone():
    new, found = pii.replace("Anna Weber came. ANNA left; Anna's bag stayed with Karen. Annabel saw it.", b"k")
    assert [k for _, _, k, _ in found] == ["given_f", "name", "given_f", "given_f"]
    first = new.split()[0]
    assert first != "Anna" and f"{first.upper()} left; {first}'s bag stayed with Karen. Annabel" in new


def test_country_script_and_gender_stay():
    text = "+49 30 1234567, +49 (0)30 1234567, +33 1 23 45 67 89, +351 21 123 4567; Dr Παπαδόπουλος, Mr. 王伟, 请王伟先生, Mr محمد علي; Dr. Xavier Smith, Ms. Wanda, Xavier; 8.8.8.8, 172.16.3.4"
    new, _ = pii.replace(text, b"k")
    m = re.fullmatch(r"\+49 (\d\d \d{7}), \+49 \(0\)(\d\d \d{7}), \+33 [1-9] \d\d \d\d \d\d \d\d, \+351 \d\d \d{3} \d{4}; Dr ([Α-Ωά-ώ]{12}), Mr\. ([一-龥]{2}), 请([一-龥]{2})先生, Mr ([ء-ي]{4}) ([ء-ي]{3}); Dr\. ([A-Z][a-z]{4}r) [A-Z][a-z]{3}h, Ms\. ([A-Z][a-z]{3}a), (\w+); (\S+), 172\.(1[6-9]|2\d|3[01])\.\d\.\d", new)
    assert m and m[1] == m[2] and m[4] == m[5] and m[8] == m[10]
    assert pii.address_class([int(x) for x in m[11].split(".")]) == "public"


def every(kind):
    if kind == "ip":
        return [f"192.168.{a}.{b}" for a in range(256) for b in range(0, 256)]
    if kind == "email":
        return [f"{chr(97 + i)}@example.com" for i in range(26)] + [f"{chr(97 + i)}{j}@a.org" for i in range(26) for j in range(10)]
    if kind == "secret":
        return [f"{i:08x}" for i in range(5000)] + [f"{i:07x}g" for i in range(5000)] + ["x" * n for n in range(9, 300)]
    if kind == "name":
        return ["".join(x) for n in (2, 3) for x in itertools.product("abeo", "bcdfgnr", *["ain"] * (n - 2))] + ["anno", "jemes", "кот", "ма"]
    if kind == "phone":
        return [f"1:743555{i:04d}" for i in range(2000)] + [f"1:7435{i:05d}" for i in range(0, 99999, 37)] + [f"49:30{i}" for i in range(100000, 101000)]
    if kind == "card":
        return [f"4{i:015d}" for i in range(3000)]
    if kind == "iban":
        return [f"DE{c:02d}{i:010d}" for c in range(100) for i in range(20)]
    return [f"{i:09d}" for i in range(0, 10**9, 314159)]


@pytest.mark.parametrize("kind", ["ip", "email", "secret", "name", "phone", "card", "iban", "ssn"])
def test_surrogates_are_one_to_one(kind):
    """Also where the corpus holds every entity of a shape."""
    real = [x for x in dict.fromkeys(every(kind)) if x not in pii._LISTED]
    new = [pii.surrogate(b"key", kind, x) for x in real]
    assert len(set(new)) == len(real) and all(a != b and len(a) == len(b) for a, b in zip(real, new, strict=True))
    if kind == "ip":
        assert set(new) == set(real)
    if kind == "name":
        assert not set(new) & set(pii._LISTED)
    if kind == "card":
        assert [pii.luhn(x) for x in real] == [pii.luhn(x) for x in new]


@pytest.mark.parametrize("radices", [[2], [3], [26], [1, 1, 156], [5, 20], [1, 90, 156], [2, 10, 10, 10, 10]])
def test_every_shape_is_one_cycle_that_the_key_decides(radices):
    """Also where one place is free; two elements have one order only."""
    places = list(itertools.product(*map(range, radices)))
    after = {k: {p: tuple(pii.cycled(k, "t", list(p), radices)) for p in places} for k in (b"one", b"two")}
    for step in after.values():
        at, seen = places[0], set()
        while at not in seen:
            seen.add(at)
            at = step[at]
        assert len(seen) == len(places)
    orders = {tuple(pii.cycled(b"key%d" % i, "t", list(p), radices)[-1] for p in places[:50]) for i in range(20)}
    assert len(orders) == 1 if len(places) == 2 else len(orders) > 1  # three elements have two cycles


def test_surrogates_of_short_names_and_mailboxes_depend_on_the_key():
    for kind, canon in (("email", "a@example.com"), ("email", "q@x.example.org"), ("name", "li"), ("name", "ng")):
        assert len({pii.surrogate(b"key%d" % i, kind, canon) for i in range(20)}) > 3


def test_given_names_stay_in_their_lists():
    for gender, names in pii.GIVEN.items():
        low = {n.lower() for n in names}
        assert {pii.surrogate(b"key", f"given_{gender}", n) for n in low} == low and all(pii.surrogate(b"key", f"given_{gender}", n) != n for n in low)


def test_long_texts_take_linear_time():
    import time

    took = []
    for n in (4000, 32_000):
        text = " ".join(f"user{i}@mail{i}.org 10.{i % 250}.3.{i % 199} Dr. Kim{'abcdefgh'[i % 8]}la" for i in range(n))
        pii.replace(text[:1000], b"k")
        began = time.time()
        pii.detect(text)
        took.append(time.time() - began)
    assert took[1] < 30 * took[0]


def test_coreference_by_brute_force(spark):
    draw = random.Random(6)
    pool = [f"u{i}@mail.org" for i in range(20)] + [f"10.0.0.{i}" for i in range(30)] + [f"+1 212-555-{i:04d}" for i in range(30)] + [f"Dr. Fam{x}" for x in "abcdefgh"]
    rows = [(i, " and ".join(draw.choices(pool, k=draw.randrange(5))), "x") for i in range(200)] + [(None, None, "n"), (3, "", "n"), (3, "Call 10.0.0.7 10.0.0.7", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_found string")
    got = pii.pseudonymise(docs, b"key")
    assert got.columns == ["doc_id", "text", "n_found"]
    new, image = got.collect(), {}
    for (_, before, _), r in zip(rows, new, strict=True):
        parts = before.split(" and ") if before and " and " in before else [before]
        for a, b in zip(parts, (r.text or "").split(" and ") if before else [r.text], strict=True):
            if a in pool:
                assert image.setdefault(a, b) == b and a != b  # one surrogate for one entity, everywhere
    assert len(set(image.values())) == len(image) == len({p for _, t, _ in rows for p in (t or "").split(" and ") if p in pool})
    assert new[-1].n_found == 2 and new[-2].n_found == 0 and new[-3].text is None
    assert pii.collisions(docs, b"key").count() == 0
    assert sorted(map(str, pii.pseudonymise(docs.repartition(7), b"key").collect())) == sorted(map(str, new))
    assert pii.pseudonymise(docs.where("false"), b"key").count() == 0


def test_table_is_fair_and_stable():
    names = [f"s{i}" for i in range(10)]
    table = sharding.fill(names, 1009)
    assert sorted(np.bincount(table)) == [100] + [101] * 9
    fewer = sharding.fill(names[:-1], 1009)
    moved = (table != fewer) & (table != 9)
    assert moved.mean() < 0.2
    heavy = np.bincount(sharding.fill(["a", "b"], 1009, [3, 1]))
    assert abs(heavy[0] / heavy[1] - 3) < 0.05


def table_by_hand(names, slots):
    """Each shard's whole order of preference first, then turns."""
    number = lambda name, salt: int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")
    prefer = {n: [(number(n, "offset") + j * (number(n, "step") % (slots - 1) + 1)) % slots for j in range(slots)] for n in names}
    owner = {}
    while len(owner) < slots:
        for n in names:
            if len(owner) < slots:
                owner[next(s for s in prefer[n] if s not in owner)] = n
    assert all(sorted(p) == list(range(slots)) for p in prefer.values())
    return owner


def test_placement_by_hand(spark):

    names = [f"s{i}" for i in range(7)]
    rows = [(i, "t", "x") for i in range(300)] + [(None, None, None), (5, "t", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.place(docs, "doc_id", names, 1009).collect()
    table = table_by_hand(names, 1009)
    assert len(got) == len(rows)
    for r in got:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 1009
        assert (r.slot, r.shard) == (slot, table[slot])
    assert sharding.place(docs.where("false"), "doc_id", names, 1009).count() == 0


def test_top_k_by_hand(spark):
    draw = np.random.default_rng(4)
    vectors = [[float(x) for x in draw.normal(size=6)] for _ in range(200)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(i + 200, vectors[3]) for i in range(20)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [math.nan] * 6), (303, [math.inf] * 6), (None, vectors[0]), (350, [1e12] * 6), (351, [1e9, -1e9, 1e12, 0.0, 0.0, 2.0]), (360, [1e18] * 6), (400, [1.0, 2.0]), (401, [])]
    table = topk.usable(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, id string"))
    ok = [(i, [min(2**63 - 1, max(-(2**63), math.floor(256 * x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in ok:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))[:5]
            want += [(q, r + 1, i, max(1 - 2**63, min(2**63 - 1, -s))) for r, (s, i) in enumerate(best)]
    for shard, block in ((8192, 1024), (16, 2)):
        got = topk.top_k(table, table.where("id % 50 = 0"), 5, shard, block)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert topk.top_k(table.where("false"), table.where("false")).count() == 0


def test_gradients_by_differences():
    draw = np.random.default_rng(2)
    model = mil_classifier.Model(5, 4, 3)
    for name in model.NAMES:
        setattr(model, name, draw.normal(size=getattr(model, name).shape))
    x, first, y = draw.normal(size=(9, 5)), np.array([0, 2, 3, 9]), np.array([1.0, 0, 1])

    def loss():
        p = model.forward(x, first)[-1]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, g in model.gradients(x, first, y).items():
        value = getattr(model, name)
        for at in list(np.ndindex(value.shape))[:6]:
            was = value[at]
            value[at] = was + 1e-5
            up = loss()
            value[at] = was - 1e-5
            down = loss()
            value[at] = was
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_classifier_holds_out_and_learns(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{path}/labels.parquet")
    rows = docs.unionByName(spark.createDataFrame([(None, None), (0, "")], "doc_id long, text string"))
    got = mil_classifier.classify(rows, labels).collect()
    assert len(got) == rows.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    test = [(quality[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in quality]
    assert sum(a == b for a, b in test) >= 0.93 * len(test)
    flipped = labels.withColumn("quality", 1 - labels.quality).where(mil_classifier.held_out(labels.doc_id)).unionByName(labels.where(~mil_classifier.held_out(labels.doc_id)))
    assert sorted(map(str, mil_classifier.classify(rows, flipped).collect())) == sorted(map(str, got))  # labels of held-out rows don't matter
    assert mil_classifier.classify(docs.where("false"), labels.where("false")).count() == 0


def features_by_hand(text):
    """Passages' features with plain loops."""
    raw, out = text.encode() or b"\0", []
    kind = mil_classifier.byte_kinds()
    for lo in range(0, len(raw), mil_classifier.PASSAGE):
        row = np.zeros(mil_classifier.WIDTH)
        part = range(lo, min(lo + mil_classifier.PASSAGE, len(raw)))
        for i in part:
            row[kind[raw[i]]] += 1
            if i:
                row[mil_classifier.KINDS + (kind[raw[i - 1]] * 31 + kind[raw[i]] * 7) % mil_classifier.PAIRS] += 1
            for lag in range(1, mil_classifier.LAGS + 1):
                row[mil_classifier.KINDS + mil_classifier.PAIRS + lag - 1] += i >= lag and raw[i] == raw[i - lag]
        out.append(np.sqrt(row / len(part)))
    return np.array(out)


def test_features_and_scores_by_hand():
    draw = np.random.default_rng(3)
    some = ["", "plain text, with marks!", "é" * 700, "".join(chr(c) for c in draw.integers(32, 900, 1500)), "x"]
    x, first = mil_classifier.encode(some)
    model = mil_classifier.Model(seed=1)
    model.c, model.mean, model.scale = draw.normal(size=32).astype(np.float32), draw.normal(size=mil_classifier.WIDTH).astype(np.float32), np.full(mil_classifier.WIDTH, 0.5, np.float32)
    score = model.score(x, first)
    for i, text in enumerate(some):
        hand = features_by_hand(text)
        assert np.allclose(x[first[i] : first[i + 1]], hand, atol=1e-6)
        alone = mil_classifier.encode([text])
        assert (alone[0] == x[first[i] : first[i + 1]]).all()  # whatever stands before or after
        assert model.score(*alone)[0] == score[i]
        h = np.tanh((hand - model.mean) / model.scale @ model.w + model.b)
        e = [math.exp(sum(np.tanh(p @ model.v) / (1 + np.exp(-(p @ model.u))) * model.a)) for p in h]
        z = sum(w / sum(e) * p for w, p in zip(e, h, strict=True))
        assert abs(score[i] - 1 / (1 + math.exp(-(z @ model.c + model.d[0])))) < 1e-4


def test_long_texts_are_encoded_in_blocks():
    text = "".join(chr(c) for c in np.random.default_rng(1).integers(32, 300, 3_100_000))
    x, first = mil_classifier.encode(["a", text, "b"])
    whole, _ = mil_classifier.features([text.encode()])
    assert (x[first[1] : first[2]] == whole).all() and first.tolist() == [0, 1, 1 + len(whole), 2 + len(whole)]


def test_scores_do_not_depend_on_partitions(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs.unionByName(docs.limit(7)).unionByName(spark.createDataFrame([(None, None), (0, "")], "doc_id long, text string"))
    rows = rows.withColumn("score", rows.text).withColumn("id", rows.text)
    one, many = (sorted(map(str, mil_classifier.classify(r, labels, epochs=3).collect())) for r in (rows.repartition(1), rows.repartition(40)))
    assert one == many and len(one) == rows.count()


def test_training_is_bounded(spark):
    docs = spark.createDataFrame([(i, "word " * (i * 50)) for i in range(60)] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen = []
    train = mil_classifier.Model.train
    try:
        mil_classifier.Model.train = lambda self, x, first, y, **o: seen.append((len(x), len(y))) or self
        mil_classifier.fit(docs, labels, most=10)
        mil_classifier.fit(docs, labels, passages=40)
    finally:
        mil_classifier.Model.train = train
    assert seen[0][1] == 10 and 0 < seen[1][0] <= 40
