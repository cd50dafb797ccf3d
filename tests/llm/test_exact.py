"""Operators that have one right result, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from omenflow.llm import decontaminate, licenses, line_dedup, minhash, mixing, range_coder, simhash, token_files
from omenflow.llm.queries import tokenizer_path

SPACES = " \t\n\x0b\x0c\r"
LEAST = -(10**30)


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def order(doc_id):
    return LEAST if doc_id is None else doc_id


def lines_by_brute_force(rows):
    key = lambda line: ascii_lower(line.strip(SPACES))
    docs = {}
    for doc, text in rows:
        for line in text.split("\n"):
            docs.setdefault(key(line), set()).add(order(doc))
    out = []
    for doc, text in rows:
        lines = text.split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(docs[key(x)]) == order(doc)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("table", ["odd", "none", "small"])
def test_line_dedup(request, table):
    docs = request.getfixturevalue(table)
    found = line_dedup.line_dedup_digest(docs).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in found) == lines_by_brute_force(rows_of(docs))


def test_line_dedup_splits_a_hot_line(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('the very same line\\nown line number ', id, '\\nthe very same line') as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = line_dedup.line_dedup_digest(docs).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["n_dropped"] for r in found) == 2 * 2999
    assert [r["doc_id"] for r in found if not r["n_dropped"]] == [0]


def mix_by_brute_force(rows, weights=(5, 2, 1), most=3):
    from fractions import Fraction

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    own = Counter()
    for _, text, s in rows:
        own[s] += size(text)
    budget, target, open_ = Fraction(sum(own.values())), {}, set(sources)
    while open_:
        share = {s: budget * w[s] / sum(w[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > most * own[s]}
        if not above:
            target |= share
            break
        for s in above:
            target[s] = Fraction(most * own[s])
            budget -= target[s]
        open_ -= above
    return own, target, size


@pytest.mark.parametrize("table", ["odd", "none", "small"])
def test_mixing(request, table):
    docs = request.getfixturevalue(table)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]
    own, target, size = mix_by_brute_force(rows)
    found = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in found) == Counter((d, s, size(t)) for d, t, s in rows)
    taken, largest = Counter(), Counter()
    for r in found:
        assert r["source_size"] == own[r["source"]] and r["target"] == pytest.approx(float(target[r["source"]]))
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s, goal in target.items():
        assert abs(taken[s] - goal) <= largest[s] or s in (None, "b", "c")  # ties of one id are taken together
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(docs).collect()))
    copies = Counter(r["doc_id"] for r in found for _ in range(r["copies"]))
    kept = mixing.take_mix(docs)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == copies


def simhash_by_brute_force(rows):
    prints = []
    for doc, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", ascii_lower(text)) if w]
        parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        prints.append((doc, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    group = list(range(len(prints)))

    def root(a):
        while group[a] != a:
            a = group[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                group[b] = a
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, f"{fp:016x}", least.get(root(i))) for i, (doc, fp) in enumerate(prints)], [least.get(i) for i in range(len(group)) if group[i] == i]


@pytest.mark.parametrize("table", ["odd", "none", "small"])
def test_simhash(request, table):
    docs = request.getfixturevalue(table)
    expected, heads = simhash_by_brute_force(rows_of(docs))
    found = simhash.near_duplicate_digest(docs).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found) == Counter(expected)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(order(r["doc_id"]) for r in kept.collect()) == sorted(map(order, heads))


def test_bit_sliced_groups_with_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 50)
    rng = np.random.default_rng(7)
    seeds = rng.integers(0, 2**63, 6, dtype=np.uint64)
    flip = lambda: np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)
    prints = np.unique(np.concatenate([s ^ flip() ^ flip() for s in seeds]))
    links = simhash.near_links(spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")).collect()
    group = {int(x): int(x) for x in prints.view(np.int64)}

    def root(a):
        while group[a] != a:
            a = group[a]
        return a

    for r in links:
        group[root(r["a"])] = root(r["b"])
    parts = {frozenset(x for x in group if root(x) == root(y)) for y in group}
    group = {x: x for x in group}
    for i, x in enumerate(prints):
        for y in prints[:i][np.bitwise_count(prints[:i] ^ x) <= 3]:
            group[root(int(x.view(np.int64)))] = root(int(y.view(np.int64)))
    assert parts == {frozenset(x for x in group if root(x) == root(y)) for y in group} and len(parts) >= 6


@pytest.mark.parametrize("table", ["odd", "none", "small"])
def test_licenses(request, table):
    docs = request.getfixturevalue(table)
    expected = []
    for doc, text in rows_of(docs):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
        places = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in places]
        expected.append((doc, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    found = licenses.scan_licenses(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found) == Counter(expected)
    for r in found:
        labels = r["labels"].split(",")
        assert labels == sorted(labels) and set(filter(None, r["base_labels"].split(","))) <= set(labels)
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


def test_license_wordings(spark):
    texts = ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files",
             "Licensed under the Apache License, Version 2.0", "licensed under cc by-nc 4.0", "a permissive text that is free of charge"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(docs).collect()}
    assert found == {0: "mit-grant", 1: "apache,apache-2.0", 2: "cc-by,cc-by-nc", 3: ""}


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("table", ["none", "small"])
def test_fingerprints(request, table):
    docs = request.getfixturevalue(table)
    rows = sorted(rows_of(docs))
    found = {r["doc_id"]: r for r in minhash.fingerprint_digest(docs).collect()}
    assert len(found) == len(rows)
    errors = []
    for i, (doc, text) in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)][1], len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = found[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if len(shingles(text)) > 50:
            for other, near in ((edited, r["near_edited"]), (after, r["near_next"])):
                a, b = shingles(text), shingles(other)
                errors.append(near - len(a & b) / len(a | b))
    if errors:
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_fingerprints_of_odd_rows(odd):
    found = minhash.fingerprint_digest(odd).collect()
    assert len(found) == odd.count()
    by_print = {}
    for r in minhash.document_fingerprints(odd).collect():
        by_print.setdefault(r["text"], set()).add(tuple(r["bits"]))
    assert all(len(v) == 1 for v in by_print.values())
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and len(r["fingerprint"]) == minhash.BINS for r in found)


@pytest.mark.parametrize("table", ["odd", "none", "small"])
def test_token_files(request, table):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(table)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    found = sorted(token_files.token_digest(docs, tokenizer_path()).collect(), key=lambda r: r["start"])
    assert [order(r["doc_id"]) for r in found] == sorted(order(d) for d, _ in rows_of(docs))
    coded = {(d, t): np.array(tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u4") for d, t in rows_of(docs)}
    start = 0
    for r in found:
        assert r["start"] == start
        start += r["n_tokens"]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == Counter(
        (d, len(coded[d, t]), zlib.crc32(coded[d, t].tobytes())) for d, t in rows_of(docs)
    )


def test_encoder_cuts_only_where_the_tokenizer_does():
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(tokenizer_path()), token_files.Encoder(tokenizer_path())
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "bc", " ", "  ", "\n", "\t", "'s", "1", ".", "é", "日", " ", "<|endoftext|>"]) for _ in range(rng.randrange(14))) for _ in range(3000)]
    assert all(found.tolist() == tokenizer.encode(t, add_special_tokens=False).ids for t, found in zip(texts, encoder.encode(texts)))


def test_encoder_asks_for_many_chunks_at_once(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer, encoder, asked = Tokenizer.from_file(tokenizer_path()), token_files.Encoder(tokenizer_path()), []
    whole = encoder._whole
    monkeypatch.setattr(encoder, "_whole", lambda texts: asked.extend(texts) or whole(texts))
    texts = [" ".join(f"many{k}chunks{i}" for i in range(700)) for k in range(10)]
    assert all(found.tolist() == tokenizer.encode(t, add_special_tokens=False).ids for t, found in zip(texts, encoder.encode(texts)))
    assert len(asked) < 30  # the ten that begin a text, and the 6,990 others in a few texts


def test_range_coder_round_trip_and_checks():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 65536, n) for n in (0, 1, 5, 700)] + [np.zeros(3000, int), rng.integers(0, 4, 2500), np.tile(rng.integers(0, 50000, 40), 60)]
    coded = range_coder.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, range_coder.decode(coded)))
    assert range_coder.encode(blocks[3:4]) == coded[3:4]  # blocks do not depend on each other
    assert len(coded[4]) < 150 and len(coded[6]) < 1500
    spoiled = bytearray(coded[3])
    spoiled[-9] ^= 4
    for bad in (bytes(spoiled), coded[3][:-1], coded[3][:5], b"????" + coded[3][4:]):
        with pytest.raises(ValueError):
            range_coder.decode([bad])


def test_joined_checksums():
    rng, zeros = random.Random(2), []
    for _ in range(50):
        a, b = (bytes(rng.randrange(256) for _ in range(rng.randrange(300))) for _ in range(2))
        assert token_files.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b), zeros) == zlib.crc32(a + b)


def edit_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(3)
    for _ in range(200):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 80)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        assert decontaminate.Pattern(a).best(b) == edit_distance(a, b)


def leaks_by_brute_force(rows, items):
    out = {}
    for doc, text in rows:
        plain, found = decontaminate._plain(text), set()
        for item, wording in items:
            for passage in decontaminate.passages(decontaminate._plain(wording)):
                if edit_distance(passage, plain) <= int(len(passage) * decontaminate.ERRORS):
                    found.add(item)
        out[doc] = sorted(found)
    return out


def test_leaks(spark, odd, none):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("etaoinsh") for _ in range(rng.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((12, 30, 60, 3))] + [(9, None), (None, "no id"), (10, "")]
    items.append((5, items[0][1].upper()))
    docs = []
    for i in range(24):
        text = [word() for _ in range(rng.randrange(60))]
        if i % 2:
            leak = list(rng.choice(items[:4])[1])
            for _ in range(rng.choice([0, 2, 5, 30])):
                leak[rng.randrange(len(leak))] = rng.choice("xyz")
            text.insert(rng.randrange(len(text) + 1), "".join(leak))
        docs.append((i, "  ".join(text) if i % 3 else "\n".join(text)))
    schema = "item_id long, text string"
    benchmark = spark.createDataFrame(items, schema)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    expected = leaks_by_brute_force(docs, [(i, t or "") for i, t in items if i is not None])
    assert {r["id"]: r["items"] for r in decontaminate.find_leaks(table, benchmark).collect()} == expected
    assert {r["doc_id"]: r["items"] for r in decontaminate.leak_digest(table, benchmark).collect()} == {d: x for d, x in expected.items() if x}
    assert sum(map(bool, expected.values())) >= 6
    kept = decontaminate.drop_leaks(table, benchmark)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {d for d, x in expected.items() if not x}
    assert decontaminate.find_leaks(odd, benchmark).count() == odd.count() == decontaminate.drop_leaks(odd, benchmark).count()
    empty = spark.createDataFrame([], schema)
    assert decontaminate.leak_digest(odd, empty).count() == 0 == decontaminate.find_leaks(none, benchmark).count()
    assert decontaminate.find_leaks(odd, empty).count() == odd.count()


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 2)
    items = [(i, f"the benchmark question number {i * 1111} asks for something quite particular") for i in range(5)]
    docs = [(1, "before " + items[3][1] + " after"), (1, "before " + items[3][1] + " after"), (2, "nothing here"), (3, items[0][1] + " " + items[4][1])]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    by_doc = {r["id"]: set(r["items"]) for r in found.collect()}
    assert found.count() == 4 and 3 in by_doc[1] and not by_doc[2] and {0, 4} <= by_doc[3]
