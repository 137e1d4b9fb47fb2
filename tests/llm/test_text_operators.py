"""Operators on documents against plain Python."""
import re
import zlib
from itertools import combinations

import pyarrow as pa
import pytest

from fixtures import documents, rows_of, texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def runs(text, k):
    w = words(text)
    return {tuple(w[i: i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(rows, k, percent):
    sets = [runs(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    return [(d, len(s), low[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("k,percent,block,chunk", [(3, 90, 1024, 256), (5, 80, 1024, 256), (3, 90, 1, 2), (5, 80, 2, 3)])
def test_jaccard_components(spark, monkeypatch, k, percent, block, chunk):
    from canopyframe.llm import jaccard
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    plain = [(r[0], r[1]) for r in texts()]
    got = rows_of(jaccard.jaccard_components(documents(spark), k=k, percent=percent), "doc_id", "n_shingles", "component_id")
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert got == sorted(groups(plain, k, percent), key=key)


def test_trie_links_what_brute_force_links():
    import random

    import numpy as np

    from canopyframe.llm.jaccard import Trie, signatures
    rng = random.Random(8)
    base = [rng.sample(range(1, 1 << 62), 80) for _ in range(4)]
    sets = []
    for i in range(60):
        s = set(rng.choice(base))
        for _ in range(rng.randrange(16)):
            s.discard(rng.choice(sorted(s)))
            s.add(rng.randrange(1 << 62))
        sets.append(s)
    sets = [np.array(sorted(s), dtype=np.uint64) for s in {tuple(sorted(s)): s for s in sets}.values()]
    for percent in (80, 90):
        want = set()
        for i, j in combinations(range(len(sets)), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                want.add((i, j))
                assert np.intersect1d(signatures(sets[i], percent), signatures(sets[j], percent)).size
        got = Trie(sets, list(range(len(sets))), percent).join()
        assert {tuple(sorted(x)) for x in got} <= want

        def partition(links):
            up = list(range(len(sets)))
            for i, j in links:
                a, b = i, j
                while up[a] != a:
                    a = up[a]
                while up[b] != b:
                    b = up[b]
                up[a] = b
            find = lambda i: i if up[i] == i else find(up[i])
            roots = {}
            for i in range(len(sets)):
                roots.setdefault(find(i), set()).add(i)
            return sorted(map(sorted, roots.values()))

        assert partition(got) == partition(want)


def test_jaccard_empty_table_and_keep_one(spark):
    from canopyframe.llm import jaccard
    assert jaccard.jaccard_components(documents(spark, [])).count() == 0
    kept = jaccard.keep_one(documents(spark), k=5, percent=80)
    assert kept.columns == documents(spark).columns
    got = [r[0] for r in rows_of(kept, "doc_id")]
    want = {d for d, n, c in groups([(r[0], r[1]) for r in texts()], 5, 80) if d is not None and (n == 0 or c == d)}
    assert sorted(x for x in got if x is not None) == sorted(want)
    assert got.count(None) == 2


@pytest.mark.parametrize("block,chunk", [(1024, 256), (1, 2)])
def test_jaccard_one_id_on_several_texts(spark, monkeypatch, block, chunk):
    import random

    from canopyframe.llm import jaccard
    from fixtures import sentence
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rng = random.Random(12)
    base = [sentence(rng, 100) for _ in range(12)]
    near = [t + " more" for t in base]
    # id 50 stands on twelve texts; ids 1 to 5 and 60 to 64 are copies of some of them, and two of its texts are near copies of each other
    plain = [(50, t) for t in base] + [(i + 1, near[i]) for i in range(5)] + [(60 + i, near[5 + i]) for i in range(5)] + [(50, near[10]), (50, base[11])]
    docs = documents(spark, [(i, t, None, None, None, 1.0, "h", 1, "w") for i, t in plain])
    want = groups(plain, 5, 80)
    assert rows_of(jaccard.jaccard_components(docs.repartition(5)), "doc_id", "n_shingles", "component_id") == sorted(want)
    kept = rows_of(jaccard.keep_one(docs.repartition(5)), "doc_id", "text")
    assert [i for i, _ in kept] == [1, 2, 3, 4, 5] + [50] * 7
    assert {t for i, t in kept if i == 50} == {*base[5:10], near[10], base[11]}


def test_media_round_trip_and_damage(spark):
    from canopyframe.llm import ogg
    df = ogg.read_media(ogg.with_media(documents(spark), "text"), ["doc_id", "text", "score"])
    rows = df.collect()
    assert len(rows) == len(texts()) and all(r.ok for r in rows)
    for r in rows:
        data = (r.text or "").encode()
        size = max(576, -(-len(data) // 576) * 576)
        assert r.payload == data + b"\xff" * (size - len(data))
        assert r.tail_crc32 == zlib.crc32(r.payload[-32:]) and r.payload_bytes == size
    whole = ogg.write(ogg.pad(b"x" * 50_000))
    assert ogg.read(whole)[0] == ogg.pad(b"x" * 50_000)
    for bad in (whole[:-1], whole[:100] + b"?" + whole[101:], b"", b"junk", whole + whole, whole[: len(whole) // 2]):
        with pytest.raises(ogg.Damaged):
            if not ogg.read(bad)[0]:
                raise ogg.Damaged
    broken = spark.createDataFrame([(1, whole), (2, whole[:-1]), (3, None), (4, b"")], "doc_id long, media binary")
    assert [r[1] for r in rows_of(ogg.read_media(broken, ["doc_id"]), "doc_id", "ok")] == [True, False, False, False]


def test_ogg_checksum_and_continued_packets():
    from canopyframe.llm import ogg

    def bitwise(data):
        crc = 0
        for b in data:
            crc ^= b << 24
            for _ in range(8):
                crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        return crc

    for data in (b"", b"OggS", bytes(range(256)) * 3):
        assert ogg.checksum(data) == bitwise(data)
    body = bytes(range(250)) * 3
    first = ogg.page(ogg.FIRST, -1, 9, 0, b"\xff\xff", body[:510])
    second = ogg.page(ogg.CONTINUED | ogg.LAST, 750, 9, 1, bytes([240]), body[510:])
    assert ogg.demultiplex(first + second) == {9: [(body, 750)]}


def license_brute(text):
    from canopyframe.llm.licenses import PHRASES
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i: i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(spark):
    from canopyframe.llm import licenses
    grant = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
    lines = ["Released under the MIT License.", "x CC BY-NC 4.0. y cc by nc z", "Licensed under the Apache License, Version 2.0. under the mit license", "under the mit", "mit license under the", "",
             None, "THE MIT LICENSE", "under the  mit\nlicense " * 300, grant, grant.replace("any person", "any one person"), grant[:40], "GNU General Public License, version 3."]
    rows = [(i, t, None, None, None, 0.5, "h", 1, "w") for i, t in enumerate(lines)] + [(None, lines[0], None, None, None, 0.5, "h", 1, "w"), (0, lines[0], None, None, None, 0.5, "h", 1, "w")]
    out = licenses.scan(documents(spark, rows))
    got = rows_of(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert got == sorted(((r[0], *license_brute(r[1])) for r in rows), key=key)
    labels = dict(rows_of(out, "doc_id", "labels"))
    assert labels[9] == "mit" and labels[10] == "mit" and labels[11] == "" and labels[12] == "gpl-3" and labels[1] == "cc-by-nc"
    assert licenses.scan(documents(spark, [])).count() == 0


def test_decontamination(spark):
    from canopyframe.llm import decontaminate
    from fixtures import sentence
    import random
    rng = random.Random(3)
    items = [(1, sentence(rng, 30)), (2, sentence(rng, 60)), (3, "one two"), (4, None), (5, ""), (6, sentence(rng, 12)), (6, sentence(rng, 12)), (None, sentence(rng, 9))]
    w = items[1][1].split()
    inside = sentence(rng, 5_000) + " " + items[0][1].upper() + " " + sentence(rng, 50)
    lines = [(1, inside), (2, " ".join(w[:54])), (3, " ".join(w[:40])), (4, items[5][1] + " x"), (5, "One  two"), (6, None), (7, ""), (None, items[0][1]), (8, items[0][1]), (8, items[0][1])]
    docs = documents(spark, [(i, t, None, None, None, 1.0, "h", 1, "w") for i, t in lines])
    table = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double")
    want = set()
    for d, t in lines:
        for i, x in items:
            s = runs(x, 5)
            if s and len(s & runs(t, 5)) * 100 >= 80 * len(s) and d is not None:
                want.add((d, i))
    assert set(rows_of(decontaminate.pairs(docs, table), "doc_id", "item_id")) == want
    assert want == {(1, 1), (2, 2), (4, 6), (5, 3), (8, 1)}
    left = decontaminate.clean(docs, table)
    assert [r[0] for r in rows_of(left, "doc_id")] == [3, 6, 7] and left.columns == docs.columns
    assert decontaminate.clean(docs, table.limit(0)).count() == len(lines)
    assert decontaminate.pairs(documents(spark, []), table).count() == 0


def pfair(weights):
    """Earliest deadline first, slot by slot."""
    total = sum(weights.values())
    done = dict.fromkeys(weights, 0)
    for slot in range(total):
        ready = [(-(-(done[s] + 1) * total // q), -q, s) for s, q in weights.items() if done[s] * total // q <= slot]
        s = min(ready)[2]
        yield s
        done[s] += 1


def test_mix(spark):
    from canopyframe.llm import mixing
    weights = {"a": 5, "b": 3, "c": 1, "*": 2}
    plan = [r[1] for r in sorted(rows_of(mixing.period(spark, weights), "slot", "source"))]
    assert plan == list(pfair(weights))
    done = dict.fromkeys(weights, 0)
    for t, s in enumerate(plan, 1):
        done[s] += 1
        assert all(abs(done[x] - weights[x] * t / 11) < 1 for x in weights)
    rows = [(i if i % 50 else None, f"t{i}", None, {0: "a", 1: "a", 2: "b", 3: None, 4: "z"}[i % 5] if i % 7 else "c", None, 1.0, "h", 1, "w") for i in range(400)]
    rows += [rows[3]] * 3
    docs = documents(spark, rows).withColumnRenamed("host", "mix_slot")
    for per_range in (20_000, 10):
        mixing.RANGE_ROWS = per_range
        out = mixing.mix_sources(docs, weights, block=4).collect()
        mixing.RANGE_ROWS = 20_000
        assert len(out) == len(rows)
        assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in out)
        for s in weights:
            assert sorted(r.mix_rank for r in out if r.mix_source == s) == list(range(sum(r.mix_source == s for r in out)))
        end = min(r.mix_slot for r in out if not r.mix_in)
        slots = {}
        for r in out:
            slots.setdefault(r.mix_slot, set()).add(r.mix_source)
        assert all(len(x) == 1 for x in slots.values())
        assert set(range(max(r.mix_slot for r in out if r.mix_in))) <= set(slots) and end > 0
    assert mixing.mix_sources(documents(spark, []), weights).count() == 0
    with pytest.raises(ValueError):
        mixing.reduced({"a": 0})


def test_media_batches_are_bounded_by_bytes(spark, monkeypatch):
    from canopyframe.llm import ogg
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 40, None, "b" * 70, "c", "d" * 30, "e" * 30])], ["text"])
    monkeypatch.setattr(ogg, "MAX_BYTES", 64)
    assert [b.num_rows for b in ogg._rows(batch, 0)] == [2, 1, 3]
    df = spark.createDataFrame([(1, "x", b"old"), (2, None, b"old")], "doc_id long, text string, media binary")
    assert ogg.with_media(df, "text").columns == ["doc_id", "text", "media"]
