"""Operators 3, 5, 8 and 10: brute force, planted cases, held-out accuracy, edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from returnsight.llm import quality, toxicity
from returnsight.llm.common import fit_sample
from returnsight.llm.licenses import TEMPLATES, aligned, find_licenses, license_scan, template_index, winnowed, words_of
from returnsight.llm.logistic import fit
from returnsight.llm.secret_scan import COMMON_WORDS, MIN_GUESS_BITS, base_spans, find_spans, guess_bits, masked_text, secret_spans, without_secrets

SF01 = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, p string, row int, host string, found string, score double"


def edge_docs(spark, extra=()):
    rows = [(1, None, "en", "s"), (2, "", None, None), (3, "word " * 30000, "en", "s"), (4, "same text", "en", "s"), (4, "same text", "en", "s"), (None, "no id", "en", ""), (6, "\n \t", "en", "s"), *extra]
    return spark.createDataFrame([(i, t, la, so, 0 if t is None else len(t), "x", 1, "y", "z", 0.5) for i, t, la, so in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")


# --- secrets


def plain_base(text):
    out = []
    for kind, (name, rx) in enumerate((("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+")))):
        for m in rx.finditer(text):
            if {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}[name](m):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_by_brute_force():
    rng = random.Random(2)
    bits = ["password", "PassWd", "secret", "toKen", "apikey", "API_KEY", '"', "'", " ", "  ", ":", "=", "abcdefgh", "x1", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef", "é", "\n", "ſecret", "toKen", "-_./+"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert base_spans(text) == plain_base(text), text


def cheapest(value):
    """guess_bits of short lower-case values of letters only, over all segmentations into words and spans."""
    best = math.inf
    for cuts in itertools.product((False, True), repeat=len(value) - 1):
        parts = "".join(c + ("|" if k < len(cuts) and cuts[k] else "") for k, c in enumerate(value)).split("|")
        cost = sum(1.0 + (min(math.log2(COMMON_WORDS.index(p) + 2), len(p) * math.log2(26)) if p in COMMON_WORDS else len(p) * math.log2(26)) for p in parts)
        best = min(best, cost)
    return best


@pytest.mark.parametrize("value", ["lovehnj", "xkgsun", "moonkzstar", "qzkfwvhn", "userroot", "k"])
def test_guess_cost_is_the_minimum(value):
    assert guess_bits(value) == pytest.approx(cheapest(value))


def test_guess_cost_orders_values():
    for weak in ("password123", "letmein2020", "qwertyuiop", "aaaaaaaaaaaa", "changeme", "P@ssw0rd!", "19991231", "abcabcabcabc", "summer2023!", "your_password_here"):
        assert guess_bits(weak) < MIN_GUESS_BITS, weak
    for strong in ("xK9#mQ2$vL7p", "45bb0d53635bf1b89d", "jF8!kd_92LqZ", "gtR kw81 zzQ!"):
        assert guess_bits(strong) >= MIN_GUESS_BITS, strong
    assert guess_bits("") == 0
    assert guess_bits("aZ" * 50000) < 60  # linear in the length


def test_contexts():
    text = 'pwd: xK9#mQ2$vL7p, bearer abcQz91kdLpTT7xx pwd=changeme postgres://bob:h8KQzL0pw2x@host passphrase: "gtR kw81 zzQ!" password=b7db7aa4a5fcc78305'
    base, spans = find_spans(text, MIN_GUESS_BITS)
    assert set(base) <= set(spans)
    assert [text[s:e] for s, k, e in spans if k == 3] == ["xK9#mQ2$vL7p", "abcQz91kdLpTT7xx", "h8KQzL0pw2x", "gtR kw81 zzQ!"]


def guessed(text):
    return [text[s:e] for s, k, e in find_spans(text, MIN_GUESS_BITS)[1] if k == 3]


@pytest.mark.parametrize("value", ["xK9@fQ2!mZ7#vL", "Xk29fQmZ7b@Wq19", "xK9,fQ2;mZ7#vL", "xK(9fQ)2mZ7#vL", "xK9<fQ2>mZ7#vL", "@xK9{fQ2}mZ7vL", "xK9'fQ2\"mZ7[vL", "<xK9fQ2mZ7#vL"])
def test_unquoted_values_are_whole(value):
    for text in (f"pwd: {value}", f"pwd: {value}, and", f"(pwd={value})", f"password={value}.\n", f"pwd={value};server=db1"):
        assert guessed(text) == [value], text
        assert masked_text(text, find_spans(text, MIN_GUESS_BITS)[1], "*").count("*") == 1
    assert guessed(f"postgres://bob:{value}@db.example.com:5432/x?mail=a@b.com") == [value]
    assert guessed(f"see postgres://bob:{value}@host") == [value]


@pytest.mark.parametrize("context", ["pwd:" + " " * 30, "pwd" + " " * 30 + "= ", "pwd\t:\t\t", "'password' => ", "password=>", "password is: ", "passphrase  is ", "Bearer\t", "Bearer" + " " * 20, "pwd === "])
def test_every_context_is_judged(context):
    for value in ("xK9!fQ2#mZ7", "'xK9!fQ2#mZ7'"):
        assert guessed(f"a {context}{value} b") == ["xK9!fQ2#mZ7"]
        assert guessed(f"a {context}changeme b") == [] == guessed(f"a {context}\n{value}")


@pytest.mark.parametrize("user", ["", "u" * 65, "u" * 5000])
def test_urls_with_any_user(user):
    assert guessed(f"redis://{user}:xK9!fQ2#mZ7@host:6379") == ["xK9!fQ2#mZ7"]
    assert guessed(f"redis://{user}:changeme@host") == []


def test_values_end_before_the_next_field():
    for text in ('{"max_tokens":4096,"model":"xK9fQ2mZ7vLxx","id":[1,2]}', "pwd=changeme;server=db7.example.com", "password: <your_password_here>", "<p>pwd: changeme</p><p>Kq7#z", 'open("http://a:80/x","mail":"xK9fQ2mZ7@b.com")', 'pwd: "", x'):
        assert guessed(text) == [], text
    assert guessed("pwd=changeme;secret_key=x,pwd=xK9#mQ2$vL7p") == ["xK9#mQ2$vL7p"]


def test_secret_edges(spark):
    docs = edge_docs(spark, [(9, 'é token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" pwd: xK9#mQ2$vL7p', "en", "s"), (10, "a" * 50000 + " AKIAABCDEFGHIJKL12", "en", "s")])
    got = secret_spans(docs).collect()
    assert len(got) == docs.count()
    empty = hashlib.sha256(b"").hexdigest()
    for r in got:
        if r.doc_id == 9:
            spelled = "assign:2:51,hex:11:51"
            assert (r.n_assign, r.n_access, r.n_hex, r.n_guess) == (1, 0, 1, 1) and r.spans == spelled + ",guess:58:70"
            assert r.base_sha256 == hashlib.sha256(spelled.encode()).hexdigest()
        elif r.doc_id == 10:
            assert r.spans == "hex:0:50000,access:50001:50019"
        else:
            assert r.base_sha256 == empty and r.spans == ""
    out = without_secrets(docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    clean = {r.doc_id: r for r in out.collect()}
    assert clean[9].text == 'é [secret]" pwd: [secret]' and clean[9].n_chars == len(clean[9].text)
    assert clean[1].text is None and clean[3].text == "word " * 30000 and clean[10].text == "[secret] [secret]"
    assert secret_spans(docs.limit(0)).collect() == []


# --- licenses


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_every_template_is_found_whole_and_edited():
    rng = random.Random(1)
    for name, text in TEMPLATES:
        assert [(m.license, m.coverage) for m in find_licenses(f"éa b {text} c")] == [(name, 1.0)]
        (m,) = find_licenses(f"éa b {text} c")
        found = f"éa b {text} c"[m.start : m.end]
        assert text.startswith(found) and not re.search("[A-Za-z0-9]", text[len(found) :])
        words = text.split()
        if len(words) > 20:
            k = rng.randrange(5, len(words) - 5)
            edited = " ".join(words[:k] + ["inserted", "words"] + words[k + 1 :])
            (m,) = find_licenses(edited.upper())
            assert m.license == name and 0.9 < m.coverage < 1


def test_alignment_matches_lcs_within_the_band():
    rng = random.Random(7)
    for _ in range(200):
        template = [rng.choice("abcdefgh") for _ in range(12)]
        words = [w for w in template if rng.random() > 0.1]
        words.insert(rng.randrange(len(words) + 1), "x")
        pairs = aligned(template, words, 0)
        assert all(template[i] == words[j] for i, j in pairs) and [i for i, _ in pairs] == sorted({i for i, _ in pairs})
        hits = [j for _, j in pairs]
        assert hits == sorted(set(hits)) and lcs(template, [words[h] for h in hits]) == len(hits)
        assert len(hits) >= lcs(template, words) - 2


def test_winnowing_keeps_a_run_of_every_window():
    split, runs, _ = template_index()
    for words in split:
        kept = winnowed(words)
        assert all({k, k + 1} & kept for k in range(len(words) - 3))
    assert find_licenses("licensed to nobody under any version") == []


@pytest.mark.parametrize(
    "text,name",
    [
        ("Released under the BSD License.", "BSD"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
        ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
        ("This work is licensed under the GNU General Public License, version 3.0.", "GPL-3.0"),
        ("This work is licensed under the GNU General Public License, version 3.1.", None),
        ("This work is licensed under the GNU General Public License, version 7.", None),
        ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
        ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
        ("Licensed under CC BY 3.0.", "CC-BY-3.0"),
        ("Licensed under CC BY 4.1.", None),
        ("Licensed under the Apache License, Version 2.", "Apache-2.0"),
        ("Licensed under the Apache License, Version 1.1.", None),
        ("Released under the Foo License.", None),
    ],
)
def test_near_miss_licenses(text, name):
    assert [m.license for m in find_licenses(f"a {text} b")] == ([name] if name else [])


def test_license_edges(spark):
    docs = edge_docs(spark, [(9, "Released under the MIT License.\n" * 300, "en", "s")])
    got = {r.doc_id: r for r in license_scan(docs).collect()}
    assert got[9].n_licenses == 300 and got[9].licenses[1].start == 32
    assert all(r.n_licenses == 0 for i, r in got.items() if i != 9) and license_scan(docs).count() == docs.count()
    assert license_scan(docs.limit(0)).collect() == []
    assert words_of("İx A1")[-1] == ("a1", 3, 5)


# --- toxicity


@pytest.fixture(scope="module")
def model(spark, tables):
    return toxicity.fit(*tables)


@pytest.mark.parametrize("disguised", ["1d10t", "id!ot", "i d i o t", "i.d.i.o.t", "idiooooot", "IDIOT", "1 d 1 0 t", "i-d-i-o-t,", "!d!0t", "iiiidiot"])
def test_disguised_words_weigh_as_plain_ones(model, disguised):
    plain = model.scorer.measures("the idiot")[0]
    assert plain > 1
    assert model.scorer.measures(f"the {disguised} and")[0] >= 0.7 * plain
    assert model.scorer.measures("the ordinary and")[0] == 0


def test_signs_at_the_edges_are_read_as_letters_or_punctuation(model):
    restorer = model.scorer.restorer
    for chunk, word in (("(lown", "clown"), ("|oser", "loser"), ("|diot", "idiot"), ("+rash", "trash"), ('"(lown".', "clown"), ("(|own)", "clown"), ("idio+", "idiot"), ("idio+,", "idiot")):
        assert word in restorer.words(chunk), chunk
    for chunk, word in (("(the", "the"), ("(and)", "and"), ("this!", "this"), ("(not", "not")):
        assert set(restorer.words(chunk)) == {word}, chunk
    plain = model.scorer.measures("the idiot")[0]
    assert model.scorer.measures("the |diot and")[0] >= 0.7 * plain and model.scorer.measures("the idio+ and")[0] >= 0.7 * plain
    assert restorer.words("(((") == [] == restorer.words('"')


def test_doubled_letters_are_undone(model):
    restorer = model.scorer.restorer
    for chunk, word in (("stuupid", "stupid"), ("iddiot", "idiot"), ("mmoorroonn", "moron"), ("(iddiot)", "idiot"), ("1dd10t", "idiot")):
        assert word in restorer.words(chunk), chunk
    for word in ("letter", "added", "summer", "well"):
        assert word in restorer.words(word)
    assert model.scorer.measures("the iddiot and")[0] >= 0.7 * model.scorer.measures("the idiot")[0]


@pytest.mark.parametrize("text", ['say "i d i o t" to', "(i.d.i.o.t)", "an i   d   i   o   t", "i\td\ti\to\tt", "i\nd\ni\no\nt", "i \r\n d \r\n i \r\n o \r\n t"])
def test_spaced_words_after_any_sign_and_gap(model, text):
    assert any(r.startswith("idio") for r in model.scorer.restorer.spaced(text))
    assert any(r == "scum" for r in model.scorer.restorer.spaced('a "s c u m" b'))
    assert model.scorer.measures(text)[0] >= 0.7 * model.scorer.measures("the idiot")[0]


def test_viterbi_is_the_cheapest_reading(model):
    restorer = toxicity.Restorer(model.costs)
    for raw in ("1d1", "a.b", "$0x1", "ooo1"):
        best = math.inf
        for path in itertools.product(*(restorer.options(raw, k) for k in range(len(raw)))):
            a = b = 0
            cost, out = 0.0, ""
            for symbol, letter, price in path:
                cost += price
                if symbol > 0 or (symbol == 0 and b):
                    cost += model.costs[a][b][symbol]
                    a, b, out = b, symbol, out + letter
            cost += model.costs[a][b][0] if b else 0.0
            if cost < best - 1e-12:
                best, reading = cost, out.strip()
        assert restorer.restore(raw) == reading


def test_character_counts_cover_all_texts(spark, tables):
    docs = tables[0]
    texts = [r.text for r in docs.select("text").collect()]
    assert toxicity.character_counts(docs).sum() == pytest.approx(toxicity.trigram_counts(texts).sum(), rel=0.01)
    assert toxicity.character_counts(docs.union(docs)).sum() == 2 * toxicity.character_counts(docs).sum()


def test_toxicity_held_out_accuracy(spark, tables):
    docs, labels = tables
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    own = [(got[r.doc_id], r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 3 == 1) and g.predicted == (g.score >= 0.7) for g, _ in own)
    assert np.mean([g.predicted == y for g, y in own]) >= 0.93
    assert sum(g.predicted for g, y in own if not y) <= 0.02 * sum(not y for _, y in own)


def test_held_out_labels_are_not_read(spark, tables):
    docs, labels = tables
    fitted = {r.own_id for r in fit_sample(docs, labels, "toxic", 10**6).collect()}
    assert fitted == {r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    assert fit_sample(docs, labels, "toxic", 50).count() == 50


def test_toxicity_edges(spark, tables):
    labels = tables[1]
    docs = edge_docs(spark, [(9, "1d10t " * 5000, "en", "s"), (10, "a" * 20000, "en", "s"), (11, "1$!0" * 3000, "en", "s")])
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity_scores(docs.limit(0), labels.limit(0)).collect() == []
    alone = toxicity.toxicity_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in alone} == {0.5}


def test_logistic_separates_and_copes_with_one_class():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] - x[:, 1] > 0.2).astype(float)
    assert np.mean((fit(x, y).logit(x) > 0) == y) > 0.97
    assert fit(x, np.zeros(400)).logit(x).max() < -5


# --- quality


def test_quality_held_out_accuracy(spark, tables):
    docs, labels = tables
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    own = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([p == y for p, y in own]) >= 0.93
    assert np.mean([p for p, y in own if y]) >= 0.97


def test_sites_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab") if rng.random() < 0.9 else None, rng.choice(["x", "y", None]), rng.random()) for _ in range(300)] + [("c", "x", 0.01)]
    frame = spark.createDataFrame(rows, "host string, path string, p double")
    sites, prior = quality.site_posteriors(frame.na.fill("~"))
    total = [p for *_, p in rows]
    assert prior.share == pytest.approx((sum(total) + 0.5) / (len(rows) + 1))
    for r in sites.collect():
        own = [p for h, s, p in rows if (h or "~", s or "~") == (r.host, r.path)]
        host = [p for h, _, p in rows if (h or "~") == r.host]
        assert (r.n, r.host_n) == (len(own), len(host)) and r.good == pytest.approx(sum(own)) and r.host_good == pytest.approx(sum(host))
    assert prior.host_strength >= 1 and prior.path_strength >= 1


def test_sparse_sites_shrink_and_bad_ones_count(spark, tables):
    _, labels = tables
    junk = " ".join(f"w{k}&&& x{k}$$$" for k in range(60))
    text = tables[0].where("doc_id = 1").first().text
    rows = [(1000 + k, junk, "en", "bad") for k in range(60)] + [(2000 + k, text + f" {k}", "en", "good") for k in range(60)] + [(3000, text, "en", "once"), (3001, text, "en", "bad")]
    docs = tables[0].select("doc_id", "text", "lang", "source").union(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert got[3001].host_posterior < 0.3 < got[2000].host_posterior
    assert got[3001].score < got[3000].score <= 1 and abs(got[3000].host_posterior - got[2000].host_posterior) < 0.2
    assert got[3001].predicted == 1 and got[1000].predicted == 0  # a clean text on a bad site is kept


def test_quality_edges(spark, tables):
    labels = tables[1]
    docs = edge_docs(spark)
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.quality_scores(docs.limit(0), labels).collect() == []
    assert len(quality.quality_scores(docs, labels.limit(0)).collect()) == docs.count()
    kept = quality.good_only(docs, quality.fit(docs, labels))
    assert kept.schema == docs.schema
