"""Learned operators: held-out quality, folds, and awkward inputs."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
import string
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, awkward_rows
from varsight.llm import langid, quality, secrets, toxicity

SYLLABLES = {"en": "th er on an re in ed nd ha at en es of or nt ea ti to", "fr": "le de re ent ou ai on eur é è que un ch eau", "de": "en er ch ei te in nd ge be un sch ß ü ä"}
INSULTS = ["idiotic", "moronic", "scumbag", "worthless"]


def sentence(rng, lang, n=60):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def held(d):
    return zlib.crc32(str(d).encode()) % 4 == 2


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(600):
        lang = rng.choice(list(SYLLABLES))
        w = sentence(rng, lang).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
        docs.append((i, " ".join(w), lang, "s", len(" ".join(w))))
        labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (3, None, None), (99_999, 1, 1)]
    return spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs


def test_toxicity_held_out(corpus):
    docs, labels, rows = corpus
    out = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out.values())
    assert all(r["held_out"] == held(d) for d, r in out.items())
    wrong = sum(out[d]["predicted"] != (d % 6 == 0) for d in out if held(d))
    assert wrong <= 0.02 * sum(map(held, out))


def test_toxicity_learns_no_held_out_label(corpus, spark):
    docs, labels, _ = corpus
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = toxicity.score_documents(docs, labels).orderBy("doc_id").toPandas().score
    b = toxicity.score_documents(docs, flipped).orderBy("doc_id").toPandas().score
    np.testing.assert_array_equal(a, b)


def test_toxicity_awkward(awkward, clashing, nothing, corpus, spark):
    labels = corpus[1]
    out = toxicity.score_documents(awkward, labels)
    assert out.count() == len(awkward_rows()) and out.where("score is null").count() == 0
    assert toxicity.score_documents(nothing, labels).count() == 0
    model = toxicity.fit(*corpus[:2])
    kept = toxicity.score(clashing, model)
    assert kept.count() == len(awkward_rows()) and kept.schema["toxicity"].dataType.typeName() == "double"
    none = toxicity.score_documents(corpus[0], labels.limit(0)).agg(F.max("score")).first()[0]
    assert none < 0.01
    assert toxicity.drop_toxic(*corpus[:2]).columns == corpus[0].columns


def test_toxicity_is_the_same_however_rows_are_dealt(corpus):
    docs, labels, _ = corpus
    a, b, c = (toxicity.score_documents(docs.repartition(n), labels.repartition(n)).orderBy("doc_id").toPandas().score for n in (1, 3, 7))
    np.testing.assert_array_equal(a, b)
    np.testing.assert_array_equal(a, c)


def test_toxicity_telling_features(corpus):
    """The features that take part are those whose ratio, counted plainly, lies beyond its standard errors."""
    docs, labels, rows = corpus
    cfg = toxicity.ToxicityConfig(orders=(4,))
    model = toxicity.fit(docs, labels, cfg)
    known = [(text, int(i % 6 == 0)) for i, text, *_ in rows if not held(i)]
    counts = [Counter(), Counter()]
    for text, toxic in known:
        t = f" {text.lower()} "
        grams = {np.frombuffer(t[k : k + 4].encode("utf-32-le"), dtype=np.uint32).tobytes() for k in range(len(t) - 3)}
        hashed = {int(f) for g in grams for h, _ in toxicity.ngram_features(np.frombuffer(g, dtype=np.uint32), np.array([0, 4]), (4,), cfg.bits) for f in h}
        counts[toxic].update(hashed)
    n1 = sum(y for _, y in known)
    n0 = len(known) - n1
    want = set()
    for f in counts[0] | counts[1]:
        one, zero = counts[1][f] + 1, counts[0][f] + 1
        ratio = np.log(one / (n1 + 2)) - np.log(zero / (n0 + 2))
        if abs(ratio) > cfg.caution * np.sqrt(1 / one + 1 / zero):
            want.add(f)
    assert want and set(np.flatnonzero(model.table >= 0).tolist()) == want


def test_toxicity_keeps_clashing_columns(clashing, corpus):
    kept = toxicity.drop_toxic(clashing, corpus[1].limit(0))
    assert kept.columns == clashing.columns and kept.count() == len(awkward_rows())
    assert [r[0] for r in kept.select("toxicity").distinct().collect()] == ["x"]


def test_language_held_out(corpus):
    docs, _, rows = corpus
    out = {r["doc_id"]: r for r in langid.identify_documents(docs).collect()}
    right = [out[d]["lang_pred"] == lang for d, _, lang, *_ in rows if held(d)]
    assert np.mean(right) >= 0.99 and all(0 <= r["score"] <= 1 for r in out.values())


def test_language_predictions_by_plain_recursion(corpus):
    """Predictions and scores are those of the learned probabilities, summed over segmentations one by one."""
    docs, _, rows = corpus
    model = langid.fit(docs)
    table = langid.piece_table(model.config)
    p = model.columns(0, len(model.languages), len(table.pieces))
    np.testing.assert_allclose(p.sum(axis=0), 1)
    number = {piece: i for i, piece in enumerate(table.pieces)}

    def log_chance(word, k):
        sums = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            sums[end] = sum(sums[s] * p[number[word[s:end]], k] for s in range(max(0, end - table.longest), end) if word[s:end] in number)
        return np.log(sums[-1])

    got = {r["doc_id"]: r for r in langid.identify_documents(docs).where("doc_id < 40").collect()}
    for d, text, *_ in rows[:40]:
        words = langid.words_of(text)
        z = np.array([sum(log_chance(w, k) for w in words) for k in range(len(model.languages))]) / len(words) ** 0.5
        share = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[d]["lang_pred"] == model.languages[z.argmax()] and got[d]["score"] == pytest.approx(share.max(), abs=1e-4)


def test_many_languages(spark):
    """No language is left out, however rare, and blocks of them give the same as all at once."""
    rng = random.Random(2)
    signs = "abcdefghijklmnopqrstuvwxyzäöüßéèñçøåłżčšž"
    rows = []
    for k in range(40):
        own = rng.sample(signs, 6)
        rows += [(100 * k + i, " ".join("".join(rng.choice(own) for _ in range(5)) for _ in range(30)), f"l{k:02d}", "s", 1) for i in range(3 if k else 400)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    a = langid.identify_documents(docs).orderBy("doc_id", "score").toPandas()
    b = langid.identify_documents(docs, langid.LanguageConfig(block=7)).orderBy("doc_id", "score").toPandas()
    assert (a.lang_pred == b.lang_pred).all() and np.allclose(a.score, b.score)
    learned = {lang for d, _, lang, *_ in rows if not held(d)}
    assert len(learned) == 40 and set(a.lang_pred) >= learned - {"und"}


def test_language_awkward(awkward, clashing, nothing, spark):
    out = {r["doc_id"]: r for r in langid.identify_documents(awkward).collect() if r["doc_id"] is not None}
    assert {out[d]["lang_pred"] for d in (4, 5, 6)} == {"und"} and out[1]["lang_pred"] == "en"
    assert langid.identify_documents(nothing).count() == 0
    unknown = langid.identify_documents(awkward.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in unknown] == ["und"]
    full = langid.identify(clashing, langid.fit(awkward))
    assert full.count() == len(awkward_rows())


def test_forward_sums_all_segmentations():
    table = langid.piece_table(langid.DEFAULT)
    rng = np.random.default_rng(0)
    p = rng.random((len(table.pieces), 2)) * 1e-2
    number = {piece: i for i, piece in enumerate(table.pieces)}

    def total(word, lang):
        sums = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - 8), end):
                if word[start:end] in number:
                    sums[end] += sums[start] * p[number[word[start:end]], lang]
        return sums[-1]

    words = [b" the", b" nation", " é".encode(), b" x"]
    got = langid.log_likelihoods(words, p, table)
    want = np.log([[total(w, k) for k in (0, 1)] for w in words])
    np.testing.assert_allclose(got, want, rtol=1e-9)
    counts = langid.expected_counts(words, np.ones(4), p[:, 0], table)
    used = sum(counts[i] * len(table.pieces[i]) for i in np.flatnonzero(counts))
    assert used == pytest.approx(sum(map(len, words)))
    long = "é" * 100
    assert b"".join(w[1:] for w in langid.words_of(long)) == long.encode()


def test_language_whole_vocabulary_and_words():
    """Long pieces and words over 32 bytes are summed like any other, against plain recursion."""
    table = langid.piece_table(langid.DEFAULT)
    with open(langid.tokenizer_path(langid.DEFAULT.vocabulary), "rb") as f:
        vocabulary = {base64.b64decode(line.split()[0]) for line in f}
    assert vocabulary <= set(table.pieces)
    rng = np.random.default_rng(1)
    p = rng.random((len(table.pieces), 2)) * 1e-3 + 1e-9
    number = {piece: i for i, piece in enumerate(table.pieces)}
    texts = ["internationalization", "Donaudampfschifffahrtsgesellschaftskapitän", "правительственный", "достопримечательностями", "é" * 100, "z" * 2000]
    words = [w for t in texts for w in langid.words_of(t)]
    assert words == [(" " + t.lower()).encode() for t in texts]

    def total(word, lang):
        sums = [0.0] + [-np.inf] * len(word)
        for end in range(1, len(word) + 1):
            parts = [sums[s] + np.log(p[number[word[s:end]], lang]) for s in range(max(0, end - table.longest), end) if word[s:end] in number]
            sums[end] = np.logaddexp.reduce(parts)
        return sums[-1]

    np.testing.assert_allclose(langid.log_likelihoods(words, p, table), [[total(w, k) for k in (0, 1)] for w in words], rtol=1e-9)
    counts = langid.expected_counts(words, np.ones(len(words)), p[:, 0], table)
    assert counts @ np.array([len(x) for x in table.pieces]) == pytest.approx(sum(map(len, words)))


def base_spans(text):
    rules = {
        "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
        "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
    }
    found = [(m.start(), k, name, m.end()) for k, (name, (rule, group, least)) in enumerate(rules.items()) for m in rule.finditer(text) if len(m[group]) >= least]
    return ",".join(f"{name}:{s}:{e}" for s, _, name, e in sorted(found))


def secret_texts():
    rng = random.Random(7)
    out = []
    for i in range(300):
        parts = [f"plain{rng.randrange(99)} words é and mail{i}.name@host{rng.randrange(99)}.example.com or call +1-555-{rng.randrange(10**7):07d} today"]
        if i % 2:
            parts.append(f'token = "{rng.getrandbits(160):040x}" then')
        if i % 5 == 0:
            parts.append("AKIA" + "".join(rng.choice("ABCDEFGH234567") for _ in range(16)))
        if i % 7 == 0:
            parts.append(f"PASSWORD: {rng.getrandbits(64):016X}")
        rng.shuffle(parts)
        out.append(" ".join(parts))
    return [*out, "token=short secret=abcdefghijkl", "ſecret=abcdefghijklmnop", "apikey='a.b-c_d=e/f+g1'", None, "", "0123456789abcde"]


@pytest.fixture(scope="module")
def secret_docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(secret_texts())], SCHEMA).repartition(3)


def test_secret_base_spans(secret_docs):
    texts = secret_texts()
    for r in secrets.scan_documents(secret_docs).collect():
        want = base_spans(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        kinds = Counter(s.split(":")[0] for s in r["spans"].split(",") if s)
        assert (kinds["assign"], kinds["access"], kinds["hex"]) == (r["n_assign"], r["n_access"], r["n_hex"])
        assert [s for s in r["spans"].split(",") if s and not s.startswith("model")] == [s for s in want.split(",") if s]


def fresh_families(rng):
    """Makers of secrets and of harmless tokens, of fresh strings.

    Their shapes are among those that training makes too, so this checks that
    the network has learned them, not what it finds of shapes it was never shown.
    """
    alnum, hexa = string.ascii_letters + string.digits, "0123456789ABCDEF"

    def some(signs, n):
        return "".join(rng.choice(signs) for _ in range(n))

    def part(n):
        return base64.urlsafe_b64encode(rng.randbytes(n)).decode().rstrip("=")

    secret = {
        "code host token": lambda: "ghp_" + some(alnum, 36),
        "key in base64": lambda: some(alnum + "+/", 40),
        "signed token": lambda: f"eyJhbGciOiJIUzI1NiJ9.{part(40)}.{part(32)}",
        "cloud key": lambda: "AIza" + some(alnum + "-_", 35),
        "chat token": lambda: f"xoxb-{some(string.digits, 12)}-{some(string.digits, 12)}-{some(alnum, 24)}",
        "letters and digits": lambda: some(alnum, 20),
        "upper hex 40": lambda: some(hexa, 40),
        "upper hex 16": lambda: some(hexa, 16),
    }
    harmless = {
        "uuid": lambda: str(uuid.UUID(int=rng.getrandbits(128))),
        "date": lambda: f"{rng.randint(1950, 2050)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
        "phone": lambda: f"{rng.randint(200, 999)}-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}-{rng.randint(10, 99)}",
        "mail address": lambda: f"{some('abcdeilmnorst', 6)}.{some('abcdeilmnorst', 5)}{rng.randint(1, 99)}@{some('abcdeilmnorst', 5)}.com",
        "network address": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
    }
    return secret, harmless


@pytest.fixture(scope="module")
def net(secret_docs):
    return secrets.fit(secret_docs)


def test_secret_network_on_fresh_strings(net):
    """What the rules miss is found in neutral surroundings, and harmless tokens are left alone in any."""
    assert 0 < net.threshold <= 1
    rng = random.Random(1)
    neutral, suggestive = ("they wrote {} on the board yesterday", "see {}"), ("they wrote {} on the board", "api credential: {}", 'key = "{}"')

    def share(make, frames):
        texts = [f.format(make()) for f in frames for _ in range(300)]
        found = secrets._findings(texts, secrets._Screen(net))
        return np.mean([any(e - s > 3 for _, s, e in a) for _, a in found])

    secret, harmless = fresh_families(rng)
    found = {name: share(make, neutral) for name, make in secret.items()}
    assert min(found.values()) >= 0.9, found
    flagged = {name: share(make, suggestive) for name, make in harmless.items()}
    assert max(flagged.values()) <= 0.01, flagged


def test_secret_in_the_middle_of_a_long_run(net):
    """A long token run is shown piece by piece, to its end."""
    rng = random.Random(6)
    key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    text = "go to //www.plain.example/" + "some/path/of/words/" * 20 + key + "/and/more/words" * 20 + " now"
    (_, found), (_, none) = secrets._findings([text, text.replace(key, "and/then/further/words")], secrets._Screen(net))
    assert any(s <= text.index(key) < e for _, s, e in found) and not none
    cut = secrets.pieces(3, 500, net.cfg)
    assert cut[0][0] == 3 and cut[-1][1] == 500 and all(a[0] < b[0] <= a[1] for a, b in itertools.pairwise(cut))


def test_secret_fit_without_texts(nothing):
    """The made examples alone train the network."""
    assert 0 < secrets.fit(nothing, secrets.SecretConfig(fit_rows=300, epochs=2)).threshold <= 1


def test_secret_candidates(net):
    """Every token run outside the base spans is shown, and the shared responses give the network's scores."""
    text = "key QwErTyUiOpAsDfGh x1 0123456789abcdefTAIL é7"
    base = secrets.base_spans(text)
    assert [text[s:e] for s, e in secrets.other_candidates(text, base)] == ["key", "QwErTyUiOpAsDfGh", "x1", "TAIL", "7"]
    rng = random.Random(4)
    signs = "abcxyzABCXYZ0123456789 \t\n\"'=:-_/+.,;@~(é中"
    texts = [t or "" for t in secret_texts()] + ["".join(rng.choice(signs) for _ in range(rng.randrange(200))) for _ in range(300)] + [text, "a" * 39, "b1" * 60, "", "q"]
    base = [secrets.base_spans(t) for t in texts]
    shown = [(i, s, e) for i, t in enumerate(texts) for s, e in secrets.other_candidates(t, base[i])]
    parts = [secrets.pieces(s, e, net.cfg) for _, s, e in shown]
    p = net.probability(np.stack([secrets.window(texts[i], *piece, net.cfg) for (i, _, _), cut in zip(shown, parts, strict=True) for piece in cut]))
    at = np.concatenate([[0], np.cumsum([len(cut) for cut in parts])])
    best = np.maximum.reduceat(p, at[:-1])
    learned = net.threshold
    for threshold in (learned, float(np.median(best)) * 1.01):
        net.threshold = threshold
        got = secrets._findings(texts, secrets._Screen(net))
        net.threshold = learned
        clear = {x: q >= threshold for x, q in zip(shown, best, strict=True) if abs(q - threshold) > 1e-4 * threshold}
        marked = {(i, s, e) for i, (_, a) in enumerate(got) for k, s, e in a if k == "model"}
        assert marked & clear.keys() == {x for x, yes in clear.items() if yes} and marked <= set(shown)


def test_secret_fit_takes_all_texts(secret_docs, monkeypatch):
    """All candidates of all texts are examples, and all without a place in the working set end without a loss."""
    cfg = secrets.SecretConfig(fit_rows=200, epochs=4, share_rows=64)
    rng = random.Random(3)
    many = " ".join("".join(rng.choice("aeioubdgkKLT") for _ in range(rng.randint(1, 9))) + rng.choice(["", "+x", "~", "/y", ".", "=", "@b.cd"]) for _ in range(3000))
    texts = [*[t or "" for t in secret_texts()], many, "a/" * 100 + "b 12-34"]
    docs = secret_docs.unionByName(secret_docs.sparkSession.createDataFrame([(-i, t, "en", "s", len(t)) for i, t in enumerate(texts[-2:], 1)], SCHEMA))
    written, write = {}, secrets.materialize

    def keep(df, label):
        written[label] = write(df, label)
        return written[label]

    monkeypatch.setattr(secrets, "materialize", keep)
    net = secrets.fit(docs, cfg)
    want = set()
    for t in texts:
        base = secrets.base_spans(t)
        values = [(e - len(secrets._ASSIGN.match(t, s)[2]) if kind == "assign" else s, e) for kind, s, e in base]
        shown = [(1, *v) for v in values] + [(0, s, e) for s, e in secrets.other_candidates(t, base) if secrets._HARMLESS.fullmatch(t, s, e)]
        want |= {(label, secrets.window(t, *piece, cfg).tobytes()) for label, s, e in shown for piece in secrets.pieces(s, e, cfg)}
    rows = [(r["label"], bytes(r["kinds"]), r["kept"]) for r in written["examples"].collect()]
    windows = secrets.windows_of([k for _, k, _ in rows], cfg)
    assert len(rows) == len(want) and {(r[0], w.tobytes()) for r, w in zip(rows, windows, strict=True)} == want
    margin = net.margin(windows)
    np.testing.assert_allclose(secrets._Screen(net).margins([k for _, k, _ in rows]), margin, rtol=1e-3, atol=1e-3)
    working = {(r["label"], bytes(r["kinds"])) for r in written["working"].collect()}
    lost = {(label, k) for (label, k, kept), m in zip(rows, margin, strict=True) if not kept and (m if label else -m) < 1 - 1e-3}
    assert 64 < len(working) < len(rows) and lost <= working and not working & {r[:2] for r in rows if r[2]}


def test_redaction(secret_docs, awkward, clashing, nothing):
    out = secrets.redact_documents(secret_docs)
    assert out.columns == secret_docs.columns
    for r in out.collect():
        assert r["text"] is None or (base_spans(r["text"]) == "" and r["n_chars"] == len(r["text"]))
    assert secrets.scan_documents(awkward).count() == len(awkward_rows())
    assert secrets.redact_documents(clashing).columns == clashing.columns
    assert secrets.scan_documents(nothing).count() == secrets.redact_documents(nothing).count() == 0


def measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def quality_rows():
    rng = random.Random(11)
    texts = [sentence(rng, "en", 80).capitalize() + "." for _ in range(120)]
    texts += [" ".join(w + rng.choice(["%%%", "***", "|"]) for w in sentence(rng, "en", 60).split()) for _ in range(12)]
    texts += [("Same " * 70).strip(), "a line\n" * 30 + "end", sentence(rng, "en", 90).upper().replace(" ", "!! "), "a b c\n\na b c\n \n", "x y z w v u t s x y z w v u t s " * 3]
    return [(10_000 + i, t) for i, t in enumerate(texts)] + [(r[0], r[1]) for r in awkward_rows()]


def test_quality(spark, nothing, clashing):
    rows = quality_rows()
    df = spark.createDataFrame([(d, t, "en", "s", None) for d, t in rows], SCHEMA).repartition(3)
    out = quality.judge_documents(df).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in out) == Counter((d, *measures(t)) for d, t in rows)
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"]) and 0 <= r["quality"] <= 1
    kept = {r["doc_id"] - 10_000 for r in quality.keep_good(df.where("doc_id between 10000 and 20000")).collect()}
    assert kept >= set(range(120)) and not kept & set(range(120, 134))
    assert quality.judge_documents(nothing).count() == quality.keep_good(nothing).count() == 0
    assert quality.keep_good(clashing).columns == clashing.columns
    plan = quality.measure(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_estimates():
    """Votes drawn from known accuracies are told apart."""
    rng = random.Random(0)
    truth, histogram, by = [], Counter(), []
    for _ in range(4000):
        good = rng.random() < 0.8
        code = 0
        for accuracy in (0.95, 0.9, 0.85, 0.8):
            right = rng.random() < accuracy
            code = code * 3 + (0 if rng.random() < 0.2 else 2 if good == right else 1)
        truth.append(good), by.append(code)
        histogram[code] += 1
    p = quality.estimate(dict(histogram), 4)
    assert np.mean([(p[c] >= 0.5) == t for c, t in zip(by, truth, strict=True)]) > 0.93
    assert len(quality.estimate({}, 2)) == 9
