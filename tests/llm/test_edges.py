"""Nulls, empty and long texts, ties and repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerf.llm import chat_format, decontamination, jaccard_join, language_id, pii, quality_classifier, quality_rules, sentencepiece_scan, suffix_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, words string, seed long, node long"
LABELS = "doc_id long, quality int, toxic int"


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    base = " ".join(word() for _ in range(120))
    texts = [None, "", " \n\t ", "one", "a b c d", base, base, base + " tail", base.replace(" ", "  ", 3), "### $$$ !!!", "x" * 5000, "é ü ñ 漢字 \U0001f600 " * 40]
    texts += [" ".join(word() for _ in range(r.randint(1, 300))) + (" idiot moron" if i % 3 == 0 else "") for i in range(60)]
    texts += [" ".join(word() for _ in range(6000))]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s", None][i % 2], 1, 0.5, "w", 3, 4) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, "no id here", "en", "s", 1, 0.5, "w", 3, 4)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 != 0), int(i % 3 == 0)) for i in range(12, 72)] + [(None, 1, 1), (5, None, None), (7777, 0, 1)], LABELS)


def test_language_id(docs, none):
    got = {r["doc_id"]: r for r in language_id.predict_language(docs).collect()}
    assert language_id.predict_language(docs).count() == docs.count()
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2, 9))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.predict_language(none).count() == 0


def brute_force_bits(train, text):
    """Code length of a text by the definition: method C, orders 3 to 0, then 8 bits."""
    low = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())
    count = {}
    for t in train:
        data = b"\0" * 3 + low(t)
        for i in range(3, len(data)):
            for k in range(4):
                after = count.setdefault(data[i - k : i], {})
                after[data[i]] = after.get(data[i], 0) + 1
    data, bits = b"\0" * 3 + low(text), 0.0
    for i in range(3, len(data)):
        for k in (3, 2, 1, 0, -1):
            after = count.get(data[i - k : i], {}) if k >= 0 else {}
            if k < 0:
                bits += 8
            elif data[i] in after:
                bits -= np.log2(after[data[i]] / (sum(after.values()) + len(after)))
                break
            elif after:
                bits -= np.log2(len(after) / (sum(after.values()) + len(after)))
    return bits


def test_language_id_long_texts_in_parts():
    """A text longer than a step has the codes that it has in one piece, as have its neighbours."""
    r = random.Random(4)
    texts = ["ab", "", "".join(r.choice("abc d") for _ in range(2 * language_id.STEP_BYTES + 77)), "xyz"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    got = np.concatenate([codes for *_, codes in language_id._pieces(data, off)])
    assert (got == language_id._codes(data, off)).all()


def test_language_id_many_languages_and_scripts(spark):
    """More languages than two blocks, two of them in scripts that differ in trailing bytes; all against brute force."""
    r = random.Random(3)
    alphabets = [r.sample("abcdefghijklmnopqrstuvwxyz", 9) for _ in range(18)]
    alphabets += [[chr(0x0905 + k) for k in range(12)], [chr(0x0985 + k) for k in range(12)]]
    make = lambda a: " ".join("".join(r.choice(a) for _ in range(r.randint(2, 6))) for _ in range(25))
    rows = [(i, make(alphabets[i % 20]), f"l{i % 20:02d}") for i in range(240)] + [(900, "Ab", None), (901, "q \u0905", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in language_id.predict_language(df).collect()}
    held = [i for i in range(240) if got[i]["held_out"]]
    assert len(held) > 30 and all(got[i]["lang_pred"] == rows[i][2] for i in held)
    train = {}
    for i, t, lang in rows[:240]:
        if not got[i]["held_out"]:
            train.setdefault(lang, []).append(t)
    for i in [*held[:6], 900, 901]:
        bits = {k: brute_force_bits(v, dict((a, b) for a, b, _ in rows)[i]) for k, v in train.items()}
        best = min(bits, key=bits.get)
        assert got[i]["lang_pred"] == best
        assert abs(got[i]["score"] - 1 / sum(2 ** (-(b - bits[best]) / 8) for b in bits.values())) < 1e-3


@pytest.mark.parametrize("score", [quality_classifier.score_quality, toxicity.score_toxicity])
def test_classifiers(docs, none, labels, score):
    got = score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert len({round(r["score"], 9) for r in got if r["doc_id"] in (0, 1)}) == 1
    assert score(none, labels).count() == 0
    assert score(docs, labels.limit(0)).count() == docs.count()


def test_toxicity_learns(docs, labels):
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).collect()}
    bad = [got[i] for i in range(12, 72) if i % 3 == 0]
    good = [got[i] for i in range(12, 72) if i % 3]
    assert np.mean(bad) > np.mean(good) + 0.3


def test_suffix_dedup_against_brute_force(docs, none):
    rows = sorted({(r["doc_id"], r["text"]) for r in docs.where("doc_id IS NOT NULL").collect()}, key=lambda x: x[0])
    seen, want = set(), {}
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).hexdigest())
    out = suffix_dedup.remove_repeats(docs)
    got = out.collect()
    assert len(got) == docs.count()
    assert {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got if r["doc_id"] is not None} == want
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_cover_has_every_shift():
    assert {(int(a) - int(b)) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))


def test_jaccard_against_brute_force(docs, none):
    sets = {}
    for r in docs.where("doc_id IS NOT NULL").collect():
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", (r["text"] or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        sets[r["doc_id"]] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    low = {i: i for i in sets}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    got = jaccard_join.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == {i: (len(sets[i]), find(i)) for i in sets}
    assert jaccard_join.near_duplicates(none).count() == 0


def near_copy_families():
    """Families of edited copies (most too far from each other), texts around shared passages, parts of texts, copies."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    passages = [[word() for _ in range(k)] for k in (8, 20, 60)]
    out = []
    for size in (12, 40, 90, 320):
        base = [word() for _ in range(size)]
        for k in range(26):
            t = list(base)
            for _ in range(r.choice([0, 1, 1, size // 60 + 1, size // 35 + 1, size // 25 + 2])):
                t[r.randrange(len(t))] = word()
            if k % 9 == 0:
                t = t[: len(t) * 5 // 6]
            out.append(t)
        for k in range(12):
            own = [word() for _ in range(size // 3)]
            out.append(own + passages[k % 3] + [word() for _ in range(r.randrange(4))])
    out += out[::17]
    r.shuffle(out)
    return [" ".join(t) for t in out]


def components(texts):
    sets = []
    for t in texts:
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", t.lower()) if x]
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    low = list(range(len(texts)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in range(len(sets))}


@pytest.mark.parametrize("seats", [2, 16, jaccard_join.SEATS])
def test_jaccard_of_large_groups_against_brute_force(spark, seats):
    """Keys of many nodes in several components; with few seats the residues do the work, over several rounds."""
    texts = near_copy_families()
    want = components(texts)
    assert 20 < len({c for _, c in want.values()}) < len(texts) - 60
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = jaccard_join.JaccardJoin(df, keys_per_bucket=2000, seats=seats).components().collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_jaccard_keys_of_linked_sets_meet():
    """Linked sets have so many keys in common, also where a set fills too few cells."""
    r = np.random.default_rng(4)
    for n in (1, 3, 4, 20, 47, 48, 100, 287, 288, 1000, 1727):
        for _ in range(20):
            both = r.integers(0, 1 << 62, n).astype(np.uint64)
            k = int(r.integers(0, n // 4 + 1))
            a = np.unique(both)
            b = np.unique(np.concatenate([both[k:], r.integers(0, 1 << 62, int(r.integers(0, max(1, (n // 4 - k) * 4 // 3 + 1)))).astype(np.uint64)]))
            if 100 * len(np.intersect1d(a, b)) < 75 * len(np.union1d(a, b)):
                continue
            (x, p), (y, q) = jaccard_join.cell_keys(a), jaccard_join.cell_keys(b)
            assert len(np.intersect1d(x, y)) >= max(p, q), (n, len(a), len(b))


def test_band_overlap_and_sketch_bound():
    for a in range(1, 3000):
        for b in (a, min(a + 1, a * 4 // 3), a * 4 // 3):
            assert {w for w, _ in jaccard_join.bands(a)} & {w for w, _ in jaccard_join.bands(b)}, (a, b)
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 1 << 62, 400).astype(np.uint64))
    b = np.unique(np.concatenate([a[:350], r.integers(0, 1 << 62, 30).astype(np.uint64)]))
    x, y = (int.from_bytes(jaccard_join.parity_bits(s, 2), "big") for s in (a, b))
    assert (x ^ y).bit_count() <= len(np.setxor1d(a, b))


def test_decontamination(spark, docs, none):
    words = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words[:30])), (2, "too short"), (3, None), (1, " ".join(words[:30]))], "item_id long, text string")
    changed = list(words[:30])
    changed[5] = changed[17] = "other"
    extra = spark.createDataFrame([(900, "start " + " ".join(changed) + " end"), (901, " ".join(words[:10])), (902, " ".join(words[:30][::-1]))], "doc_id long, text string")
    got = decontamination.find_leaks(docs.select("doc_id", "text").unionByName(extra), bench).collect()
    assert [(r["doc_id"], r["n_items"], r["first_item"]) for r in got] == [(900, 1, 1)]
    kept = decontamination.remove_leaks(docs.select("doc_id", "text").unionByName(extra), bench)
    assert kept.count() == docs.count() + 2 and kept.where("doc_id IS NULL").count() == 1
    assert decontamination.find_leaks(none, bench).count() == 0 and decontamination.find_leaks(docs, bench.limit(0)).count() == 0


def test_pii_rules():
    text = "mail a.b@c-d.co.uk, @x.y a@b 10.0.0.1 256.1.1.1 4111 1111 1111 1111 4111111111111112 +1 (555) 123-4567 +12 x@y@z.com"
    base = pii.base_spans(text)
    assert [text[s:e] for s, e in base["email"]] == ["a.b@c-d.co.uk", "y@z.com"]
    assert [text[s:e] for s, e in base["ip"]] == ["10.0.0.1"]
    assert base["card"] == [] or all(pii.luhn("".join(c for c in text[s:e] if c.isdigit())) for s, e in base["card"])
    assert [text[s:e] for s, e in base["phone"]] == ["+1 (555) 123-4567"]


def test_pii_matches_plain_expressions():
    import re

    r = random.Random(3)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(3000):
        t = "".join(r.choice("ab1.@-+ 9(2)5%") for _ in range(60))
        base = pii.base_spans(t)
        assert base["email"] == [m.span() for m in email.finditer(t)], t
        assert base["ip"] == [m.span() for m in ip.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))], t


def test_pii_cards_and_phones_match_plain_expressions():
    import re

    r = random.Random(4)
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def checks(x):
        d = [int(c) for c in x if c.isdigit()][::-1]
        return 13 <= len(d) <= 19 and sum(v if i % 2 == 0 else sum(map(int, str(2 * v))) for i, v in enumerate(d)) % 10 == 0

    hits = 0
    for k in range(6000):
        t = "".join(r.choice("0123456789012345678 -+()." if k % 2 else "+1 2-3(4).5x") for _ in range(70))
        base = pii.base_spans(t)
        want = [m.span() for m in card.finditer(t) if checks(m.group())]
        hits += len(want)
        assert base["card"] == want, t
        assert base["phone"] == [m.span() for m in phone.finditer(t) if 9 <= sum(c.isdigit() for c in m.group()) <= 15], t
    assert hits > 20


def test_pii_adds_forms_that_the_base_rules_do_not_know(spark):
    """Precision and recall of added spans on texts with other words and values than those fitted on."""
    r = random.Random(77)
    words = lambda k: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(k))
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    fit = spark.createDataFrame([(i, f"{words(60)} {n(r.randint(1, 6))} {words(30)}") for i in range(1200)], "doc_id long, text string")
    models = pii.fit_pii(fit)
    assert set(models) == set(pii.KINDS)
    rows, want = [], {}
    for i in range(300):
        good = [("email", f"{words(1)}.{words(1)} (at) {words(1)} (dot) org"), ("ip", f"10[.]{n(2)}[.]7[.]2{n(1)}"), ("card", "4111.1111.1111.1111"), ("phone", f"(415) {n(3)}-{n(4)}")][i % 4]
        bad = [f"version 4.{n(1)}.1{n(1)}", f"order {n(12)}", f"on 2021-0{r.randint(1, 9)}-1{n(1)}", f"{words(1)} @ {n(2)}"][i // 4 % 4]
        first = f"{words(20)} "
        rows.append((i, f"{first}{good[1]} {words(20)} {bad} {words(9)} a@b.com"))
        want[i] = (good[0], len(first), len(first) + len(good[1]))
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), models).collect()
    added = {}
    for x in got:
        assert x["n_email"] == 1 and x["base_sha256"] == hashlib.sha256(f"email:{len(rows[x['doc_id']][1]) - 7}:{len(rows[x['doc_id']][1])}".encode()).hexdigest()
        spans = {(k, int(s), int(e)) for k, s, e in (p.split(":") for p in x["spans"].split(","))} - {("email", len(rows[x["doc_id"]][1]) - 7, len(rows[x["doc_id"]][1]))}
        assert len(spans) == x["n_added"]
        added[x["doc_id"]] = spans
    right = sum(want[i] in s for i, s in added.items())
    assert right >= 0.85 * len(want) and right >= 0.95 * sum(map(len, added.values()))


def test_pii_frames(docs, none):
    got = pii.find_pii(docs)
    assert got.count() == docs.count() and pii.find_pii(none).count() == 0
    assert pii.redact(docs).columns == docs.columns
    models = {"card": (pii.Trees().fit(np.array([[0.0], [1.0]] * 40), np.array([0.0, 1.0] * 40)), 0.5)}
    assert models["card"][0].score(np.array([[0.0], [1.0]])).round().tolist() == [0.0, 1.0]


@pytest.mark.parametrize("role", ["user", "assistant", "system", "tool", "", "we|>ird<s>"])
def test_chat_round_trip(role):
    r = random.Random(9)
    bits = ["</s>", "<s>", "[INST]", " [/INST]", "<<SYS>>", "<</SYS>>", "<|turn:", "|>", "<|/turn|>", "\x1a", "<", "/s>", "a", " "]
    for _ in range(400):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 9)))
        segment, start, end = chat_format.render(role, text)
        assert list(chat_format.parse(segment * 2))[1][:2] == (role, text)
        assert chat_format.unescape(segment[start:end]) == text


def test_chat_frames(spark):
    t = spark.createDataFrame([(1, 0, "user", "hi", 9), (1, 1, "assistant", None, 9), (1, None, "system", "s", 9), (None, 0, None, "x", 9), (2, 0, "assistant", "é</s>", 9), (2, 0, "assistant", "é</s>", 9)], "conv_id long, turn long, role string, text string, segment long")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_turns(t)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("system\ns\nuser\nhi\nassistant\n\n") and got[1]["loss_sha256"] == sha("")
    assert got[2]["loss_chars"] == 10 and got[2]["loss_sha256"] == sha("é</s>" * 2) and got[None]["n_turns"] == 1
    assert chat_format.read_back(chat_format.format_turns(t.limit(0))).count() == 0


def test_sentencepiece(docs, none):
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect())
    for chunk in (sentencepiece_scan.CHUNK, 64):
        got = sentencepiece_scan.round_trip(docs, chunk=chunk).collect()
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["decoded_sha256"]) for r in got) == want
        ids = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"]) for r in got)
        assert chunk == sentencepiece_scan.CHUNK or ids == whole
        whole = ids
    assert sentencepiece_scan.round_trip(none).count() == 0


def test_quality_rules(docs, none):
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(docs).collect()}
    assert got[0]["n_words"] == 0 and got[0]["base_failed"] and not got[0]["kept"]
    assert got[9]["n_symbols"] == 6 and got[11]["n_words"] == 200 and got[11]["n_repeat_words"] == 200
    assert quality_rules.apply_rules(docs).count() == docs.count() and quality_rules.apply_rules(none).count() == 0


def test_quality_rules_repeats(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice("ab") for _ in range(r.randint(0, 14))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for row in quality_rules.measure(df).collect():
        w = texts[row["doc_id"]].split()
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        assert row["n_repeat_words"] == len({i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}), w


def test_quality_rules_follow_their_group(spark):
    """One text, one measure: beyond the fence of an even source, within that of an uneven one; a small source has its
    language's."""
    r = random.Random(8)
    words = lambda n, size: " ".join("".join(r.choice("abcdefgh") for _ in range(size)) for _ in range(n))
    rows = [(i, words(200, 5), "en", "even") for i in range(60)]
    rows += [(100 + i, words(200, 4 + i % 6), "en", "wide") for i in range(60)]
    probe = words(200, 8)
    rows += [(1000, probe, "en", "even"), (1001, probe, "en", "wide"), (1002, probe, "en", "small"), (1003, words(200, 5) + " ###", "en", "even"), (1004, words(200, 5) + " #" * 9, "en", "even")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x["doc_id"]: x["kept"] for x in quality_rules.apply_rules(df).collect()}
    assert [got[i] for i in range(1000, 1005)] == [False, True, True, True, False]
    assert all(got[i] for i in range(60)) and all(got[100 + i] for i in range(60))
