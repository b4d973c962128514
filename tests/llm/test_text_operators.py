"""The text operators against brute force, round trips and held-out labels."""

from __future__ import annotations

import hashlib
import random
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracelake.llm import (
    bpe,
    counts,
    decontaminate,
    language,
    lines,
    nearest,
    pii,
    simhash,
    substrings,
    toxicity,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "key string, print string, fp string, row string, words string, gone string, kept string"
DATA = "/root/testdata/sf0.001"


def docs_of(spark, texts, extra=False):
    """Documents with ids in order; a pair gives its own id."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    found = spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in rows], SCHEMA)
    if extra:
        names = [c.split()[0] for c in CLASHES.split(", ")]
        found = found.withColumns({n: F.lit("x") for n in names})
    return found.repartition(3)


def odd_texts():
    rng = random.Random(5)
    words = ["the", "cat", "Sat", "on", "é", "mat,", "42", "x"]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    same = "same old text that is here twice and more than that it is"
    return [None, "", " \n\t ", "one", same, same, (4, same), (None, same), (None, None), (77, long), "a" * 50_000]


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def words_of(text):
    return (text or "").encode().split()


# --- operator 1


def test_bpe_is_the_librarys(spark):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(bpe.default_path())
    rng = random.Random(1)
    parts = ["a", "b", "aa", "the", " ", "  ", "\n", "é", "ñ", " ", "\u0085", "1", "23", "'s", "'ll"]
    parts += ["<|endoftext|>", "!", "...", "😀", "中", "՘", "​", "́", "Ġ", "ẞ", "e", "in", "er", "X"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)]
    texts += ["a" * 5000, "ab" * 3000, " " * 999 + "x", "nothing " * 2000]
    got = dict(map(tuple, bpe.with_token_ids(docs_of(spark, texts)).select("doc_id", "token_ids").collect()))
    want = [e.ids for e in known.encode_batch(texts, add_special_tokens=False)]
    assert [got[i] for i in range(len(texts))] == want
    odd = [[rng.randrange(50257) for _ in range(rng.randrange(9))] for _ in range(200)]
    ids = spark.createDataFrame(list(enumerate(odd)), "i long, ids array<int>")
    back = dict(map(tuple, ids.select("i", bpe.decoded(F.col("ids"))).collect()))
    assert [back[i] for i in range(len(odd))] == known.decode_batch(odd, skip_special_tokens=False)


def test_bpe_batch_and_single_pieces_agree():
    codec = bpe.bpe(None)
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"abcdeth \xc3\xa9n") for _ in range(rng.randrange(1, 60))) for _ in range(500)]
    got = codec.batch_ids(pieces)
    assert got == [np.array(codec.piece_ids(p), "<u4").tobytes() for p in pieces]


def test_bpe_round_trip_digests(spark):
    got = rows_of(bpe.round_trip(docs_of(spark, odd_texts(), extra=True)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(bpe.default_path())
    want = []
    for i, t in enumerate(odd_texts()):
        key, text = t if isinstance(t, tuple) else (i, t)
        ids = known.encode(text or "", add_special_tokens=False).ids
        raw = struct.pack(f"<{len(ids)}I", *ids)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((key, len(ids), sha(raw), sha(known.decode(ids, skip_special_tokens=False).encode())))
    assert got == sorted(want, key=repr)
    assert bpe.round_trip(docs_of(spark, [])).count() == 0


# --- operator 2


def fingerprint(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = low.split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def test_simhash_fingerprints_and_components(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(60)}" for _ in range(150)]
    texts = odd_texts()
    for _ in range(120):
        other = list(base)
        other[rng.randrange(150)] = f"v{rng.randrange(9)}"
        texts.append((1000 + len(texts), " ".join(other)))
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    found = simhash.simhash_components(docs_of(spark, texts, extra=True)).collect()
    prints = [fingerprint(t) for _, t in rows]
    assert sorted((repr(r["doc_id"]), r["fp"] % 2**64) for r in found) == sorted((repr(i), p) for (i, _), p in zip(rows, prints, strict=True))
    root = {p: p for p in prints}
    def top(p):
        while root[p] != p:
            p = root[p]
        return p
    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= 2:
                root[top(a)] = top(b)
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        least[top(p)] = min(least.get(top(p), 10**9), 10**9 if i is None else i)
    for r in found:
        want = least[top(r["fp"] % 2**64)]
        assert r["component_id"] == (None if want == 10**9 else want)


def test_links_reach_every_pair_within_two_bits(spark):
    rng = random.Random(4)
    prints = {0, 1 << 63, rng.getrandbits(64)}
    while len(prints) < 300:
        p = rng.choice(sorted(prints))
        for _ in range(rng.choice([1, 2, 2, 3, 4])):
            p ^= 1 << rng.randrange(64)
        prints.add(p)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    links = simhash.close_pairs(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    root = {p: p for p in signed}
    def top(p):
        while root[p] != p:
            p = root[p]
        return p
    for r in links:
        assert ((r["a"] ^ r["b"]) % 2**64).bit_count() <= 2
        root[top(r["a"])] = top(r["b"])
    for a in signed:
        for b in signed:
            if ((a ^ b) % 2**64).bit_count() <= 2:
                assert top(a) == top(b)


def test_one_document_of_a_group_stays(spark):
    docs = docs_of(spark, ["a b c d", "A b  c d", None, "", (None, "a b c d"), "else where", "else where"], extra=True)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert rows_of(kept, "doc_id") == [(0,), (2,), (5,)]


def test_few_links_are_one_partition(spark, monkeypatch):
    from tracelake.llm import components as module

    rng = random.Random(3)
    links = spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(200)], "a long, b long")
    few = module.components(links.repartition(5))
    assert few.rdd.getNumPartitions() == 1
    monkeypatch.setattr(module, "PART", -1)
    assert rows_of(few, "node", "root") == rows_of(module.components(links), "node", "root")


@pytest.mark.parametrize("kind", ["long", "string", "binary"])
def test_few_links_take_few_jobs(spark, kind):
    from tracelake.llm.components import components

    rng = random.Random(11)
    pairs = [(i, i + 1) for i in range(100, 300)] + [(rng.randrange(300, 700), rng.randrange(300, 700)) for _ in range(150)]
    pairs += [(999, 5), (999, 7), (999, 6), (None, 5), (5, None), (8, 8)]
    of = {"long": lambda i: i - 400, "string": lambda i: f"é{i:03d}", "binary": lambda i: bytes([200 - i // 256, i % 256])}[kind]
    named = [tuple(None if x is None else of(x) for x in p) for p in pairs]
    links = spark.createDataFrame(rng.sample(named, len(named)), f"a {kind}, b {kind}")
    context = spark.sparkContext
    context.setJobGroup(group := f"few-{kind}", "")
    try:
        found = {(r["node"], r["root"]) for r in components(links).collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    root = {x: x for p in named for x in p if None not in p and p[0] != p[1]}
    for _ in root:
        for a, b in named:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    assert found == {(x, least) for x, least in root.items() if x != least}
    assert 0 < len(context.statusTracker().getJobIdsForGroup(group)) <= 10


def test_components_of_a_long_chain_and_a_star(spark):
    from tracelake.llm.components import components

    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert {r["root"] for r in found.where("node < 500").collect()} == {0}
    assert {r["root"] for r in found.where("node > 1000").collect()} == {1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- operator 3


def test_personal_data_of_hostile_texts(spark):
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
    patterns = {"email": email, "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    def good(kind, hit):
        d = re.sub("[^0-9]", "", hit)
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in hit.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
    rng = random.Random(6)
    alphabet = ["a", "b@c.de", "@", ".", "_", "%", "1", "1.2.3.4", "256", "+1 ", "(212)", "-", " ", "4111 1111 1111 1111", "5555", "é", "😀", "\n"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += [None, "", "9" * 20_000, "a" * 20_000, "a.b@" * 5000, "x@y.zz " * 3000, "a." * 9000 + "@b.c"]
    docs = docs_of(spark, texts, extra=True)
    got = {r["doc_id"]: r["spans"] for r in pii.with_personal_data(docs).collect()}
    for i, text in enumerate(texts):
        want = sorted(
            (m.start(), k, kind, m.end())
            for k, (kind, p) in enumerate(patterns.items())
            for m in re.finditer(p, text or "")
            if good(kind, m[0])
        )
        base = [(s["start"], s["kind"], s["end"]) for s in got[i] if s["kind"] in pii.BASE]
        assert base == [(s, kind, e) for s, _, kind, e in want], text[:80]
    assert pii.with_personal_data(docs_of(spark, [])).count() == 0


def test_added_kinds_need_checksum_or_context(spark):
    texts = [
        "pay GB82 WEST 1234 5698 7654 32 now",
        "pay GB83 WEST 1234 5698 7654 32 now",
        "his social security number is 123-45-6789",
        "part number 123-45-6789",
        "ssn 000-12-3456",
    ]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.with_personal_data(docs_of(spark, texts)).collect()}
    assert got == {0: ["iban"], 1: [], 2: ["ssn"], 3: [], 4: []}


# --- operator 4


def test_maximal_segments_against_their_definition():
    rng = random.Random(7)
    def naive(s, low, high):
        best = None
        for b in range(low, high):
            total = 0
            for e in range(b, high):
                total += s[e]
                if total > 0 and (best is None or total > best[2]):
                    best = (b, e + 1, total)
        if best is None:
            return []
        return naive(s, low, best[0]) + [best] + naive(s, best[1], high)
    for _ in range(200):
        s = [rng.choice([-3, -2, -1, 1, 2, 5]) + rng.random() / 100 for _ in range(rng.randrange(25))]
        got = toxicity.maximal_segments(s)
        assert [(b, e) for b, e, _ in got] == [(b, e) for b, e, _ in naive(s, 0, len(s))]


def test_toxicity_on_texts_it_has_not_seen(spark):
    rng = random.Random(8)
    def text(bad):
        words = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}o" for _ in range(rng.randrange(40, 200))]
        for _ in range(rng.randrange(2, 5) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty", "stinkard", "stinkhead"]))
        return " ".join(words)
    rows = [(i, i % 6 == 0) for i in range(900)]
    docs = docs_of(spark, [(i, text(bad)) for i, bad in rows] + [(5000, None), (5001, "")], extra=True)
    labels = spark.createDataFrame([(i, int(bad)) for i, bad in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels.where("doc_id < 600 or doc_id is null"))
    got = {r["doc_id"]: r for r in toxicity.with_toxicity(docs, model).collect()}
    wrong = sum((got[i]["score"] >= 0.7) != bad for i, bad in rows if i >= 600)
    assert wrong <= 6
    assert got[5000]["score"] == got[5001]["score"] < 0.7
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and 740 <= kept.count() <= 760
    none = toxicity.learn(docs, labels.where("false"))
    assert toxicity.drop_toxic(docs, none).count() == docs.count()


# --- operator 5


def brute_repeats(rows, width):
    first = {}
    for key, text in rows:
        w = words_of(text)
        for p in range(len(w) - width + 1):
            h = tuple(w[p : p + width])
            first[h] = min(first.get(h, 10**9), 10**9 if key is None else key)
    out = []
    for key, text in rows:
        w = words_of(text)
        gone = set()
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < (10**9 if key is None else key):
                gone.update(range(p, p + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        out.append((key, len(w), len(gone), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("at_once", [substrings.SLICE, 64])
def test_repeated_passages_against_brute_force(spark, at_once):
    rng = random.Random(9)
    new = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    passages = [new(rng.randrange(40, 160)) for _ in range(6)]
    loop = " ".join(["again and"] * 60)
    texts = odd_texts() + [loop, loop, loop + " end"]
    for _ in range(120):
        parts = [rng.choice([new(rng.randrange(1, 60)), rng.choice(passages)]) for _ in range(rng.randrange(1, 5))]
        words = " ".join(parts).split()
        if rng.random() < 0.3:
            words = words[rng.randrange(20) :]
        texts.append(rng.choice([" ", "\n"]).join(words))
    texts = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    rng.shuffle(texts)
    got = rows_of(substrings.drop_repeats(docs_of(spark, texts, extra=True), at_once=at_once), "doc_id", "n_words", "n_removed", "kept")
    assert got == brute_repeats(texts, 50)


def test_repeats_in_an_empty_table(spark):
    assert substrings.drop_repeats(docs_of(spark, [])).count() == 0


# --- operator 6


def naive_rising(pairs):
    best = [[]]
    for i, (a, b) in enumerate(pairs):
        ends = [c for c in best if not c or c[-1][1] < b]
        best.append(max(ends, key=len) + [(a, b)])
    return max(best, key=len)


def test_longest_rising_chain():
    rng = random.Random(10)
    for _ in range(200):
        places = list(range(rng.randrange(12)))
        rng.shuffle(places)
        pairs = list(enumerate(places))
        got = lines._longest_rising(pairs)
        assert len(got) == len(naive_rising(pairs))
        assert all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:], strict=False))


def test_alignment_is_common_and_rising():
    rng = random.Random(11)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(1, 14))] for _ in range(2))
        shared = sorted(set(a) & set(b))
        held = [([i for i, x in enumerate(a) if x == s], [i for i, x in enumerate(b) if x == s]) for s in shared]
        got = lines.aligned(held)
        assert all(a[i] == b[j] for i, j in got)
        assert all(i < k and j < m for (i, j), (k, m) in zip(got, got[1:], strict=False))
        assert bool(got) == bool(shared)
        if a == b:
            assert len(got) == len(a)


def test_lines_of_later_documents_go(spark):
    block = "the first common line of all\nshort\nthe second common line here"
    texts = [
        "own words of document nought\n" + block,
        block + "\nsomething new in document one",
        "short\nnothing else is common with it",
        "own words of document nought\n" + block,
        None,
        "",
        (None, block),
        (1, block + "\nsomething new in document one"),
        "the second common line here\n\nthe first common line of all",
    ]
    docs = docs_of(spark, texts, extra=True)
    got = {(r["doc_id"], r["kept"]): (r["n_lines"], r["n_removed"]) for r in lines.line_dedup(docs).collect()}
    assert got[0, texts[0]] == (4, 0)
    assert got[1, "something new in document one"] == (4, 3)
    assert got[2, texts[2]] == (2, 0)
    assert got[3, ""] == (4, 4)
    assert got[4, ""] == got[5, ""] == (0, 0)
    assert got[None, ""] == (3, 3)
    assert sum(r["n_removed"] for r in lines.line_dedup(docs).where("doc_id = 8").collect()) == 1
    kept = lines.drop_lines(docs)
    assert kept.columns == docs.columns and kept.count() == len(texts)
    assert {r["n_chars"] for r in kept.where("doc_id = 1").collect()} == {29}
    assert lines.line_dedup(docs_of(spark, [])).count() == 0


def test_a_line_in_every_document_makes_no_pairs_of_all(spark):
    texts = [f"this line stands in every document\nand number {i} is its own line" for i in range(400)]
    got = lines.line_dedup(docs_of(spark, texts)).agg(F.sum("n_removed")).first()[0]
    assert got == 399


# --- operator 7


def test_language_known_by_long_texts_only(spark):
    rng = random.Random(4)
    words = {"aa": ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]}
    words |= {"zz": ["".join(rng.choices("qrstuvwxyz", k=6)) for _ in range(300)]}

    def text(lang, n):
        return " ".join(rng.choices(words[lang], k=n))

    # 'zz' has only texts beyond an eighth of a dictionary, whose first parts are of 'aa'.
    rows = [(i, text("aa", 50), "aa") for i in range(20)]
    rows += [(100 + i, text("aa", 300) + " " + text("zz", 4_000), "zz") for i in range(20)]
    contents = language.dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert all(len(c) <= language.DICTIONARY_BYTES for c in contents.values())
    assert sum(w.encode() in contents["zz"] for w in words["zz"]) > 200
    asked = spark.createDataFrame([(1, text("zz", 30)), (2, text("aa", 30))], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(asked, contents).collect()}
    assert got == {1: "zz", 2: "aa"}


def test_language_of_texts_it_has_not_learned(spark):
    sounds = {"aa": "ka lo mi ", "bb": "strum zen pft ", "cc": "oui eau ment "}
    rng = random.Random(12)
    def text(lang):
        parts = sounds[lang].split()
        return " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(rng.randrange(8, 60)))
    rows = [(i, rng.choice(list(sounds))) for i in range(300)]
    docs = spark.createDataFrame([(i, text(lang), lang) for i, lang in rows], "doc_id long, text string, lang string")
    contents = language.dictionaries(docs.where("doc_id < 200"))
    odd = spark.createDataFrame([(900, None, None), (901, "", None), (902, "12 + 3!", None), (None, "ka", "aa")], docs.schema)
    got = {r["doc_id"]: r for r in language.identify(docs.union(odd), contents).collect()}
    assert sum(got[i]["lang_pred"] != lang for i, lang in rows if i >= 200) <= 1
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert got[None]["lang_pred"] in sounds
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify(docs, language.dictionaries(docs.where("false"))).first()["lang_pred"] == "und"


# --- operator 8


def test_token_counts_against_encoding(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(counts, "DOCS_PER_FILE", {100: 4, 60_000: 2, None: 1})
    texts = [*odd_texts(), "<|endoftext|> in a text", "쑐 bytes PÄ", (-(2**63), "least id"), (2**62 + 7, "x")]
    docs_of(spark, texts, extra=True).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    assert counts.token_counts(docs.where("false")).count() == 0
    got = rows_of(counts.token_counts(docs, block_tokens=1000), "doc_id", "n_tokens")
    codec = bpe.bpe(None)
    want = []
    for i, t in enumerate(texts):
        key, text = t if isinstance(t, tuple) else (i, t)
        want.append((key, len(next(codec.encode([text or ""], special=False))) // 4))
    assert got == sorted(want, key=repr)


def test_token_counts_do_not_depend_on_how_files_are_read(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    texts = ["word " * rng.randrange(40) for _ in range(40)] + ["long text " * 30_000] * 3
    docs_of(spark, texts).repartition(8).write.parquet(f"{tmp_path}/docs")
    write, parts = counts.write_token_files, "spark.sql.files.minPartitionNum"

    def then_fewer_cores(*given):
        write(*given)
        spark.conf.set(parts, "2")

    monkeypatch.setattr(counts, "write_token_files", then_fewer_cores)
    spark.conf.set(parts, "8")
    try:
        got = rows_of(counts.token_counts(spark.read.parquet(f"{tmp_path}/docs")), "doc_id", "n_tokens")
    finally:
        spark.conf.unset(parts)
    codec = bpe.bpe(None)
    want = [(i, len(next(codec.encode([t], special=False))) // 4) for i, t in enumerate(texts)]
    assert got == sorted(want, key=repr)


def test_scan_of_foreign_token_files(spark, tmp_path):
    rng = np.random.default_rng(13)
    want = []
    for name in "abcd":
        ids = rng.choice([1, 50256, 65535], size=rng.integers(0, 60), p=[0.6, 0.2, 0.2]).astype("<u2")
        (tmp_path / f"{name}.bin").write_bytes(ids.tobytes() + (b"\x50" if name == "d" else b""))
        start = 0
        for end in [*np.flatnonzero(ids == 50256).tolist(), len(ids)]:
            if end < len(ids) or end > start:
                want.append((name, start, end - start, end < len(ids)))
            start = end + 1
    (tmp_path / "e.bin").write_bytes(b"")
    found = counts.scan_token_files(spark, str(tmp_path), block_tokens=7)
    found = found.withColumn("name", F.regexp_extract("file", r"(\w)\.bin$", 1))
    assert rows_of(found, "name", "first_token", "n_tokens", "closed") == sorted(want, key=repr)


# --- operator 9


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(14)
    vectors = {i: rng.normal(size=9).astype(np.float32).tolist() for i in range(400)}
    for i in range(200, 260):
        vectors[i] = vectors[200]
    vectors[40] = [1e-30] * 9
    vectors[60] = [float(x) for x in range(9)]
    odd = [(500, None), (501, [0.0] * 9), (502, [1.0, None] + [0.0] * 7), (503, [float("nan")] * 9), (504, [float("inf")] * 9), (None, [1.0] * 9), (505, []), (7, vectors[7])]
    rows = spark.createDataFrame([*vectors.items(), *odd], "vec_id long, embedding array<float>").withColumn("dim", F.lit("x"))
    got = nearest.nearest(rows, tile_rows=64, tile_queries=8).collect()
    exact = {i: np.array(v, np.float32).astype(float) for i, v in vectors.items()}
    want = []
    for q in range(0, 400, 20):
        scored = sorted((-float(np.cumsum(exact[c] * exact[q])[-1]), c) for c in exact if c != q)[:20]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert nearest.nearest(rows.where("false")).count() == 0
    assert nearest.nearest(rows.where("vec_id in (0, 1)")).count() == 1


# --- operator 10


def test_leaks_exact_edited_and_clean(spark):
    rng = random.Random(15)
    new = lambda n: [f"t{rng.randrange(10**5)}" for _ in range(n)]
    items = {i: new(rng.randrange(15, 60)) for i in range(40)}
    items[40], items[41], items[42], items[43] = ["two", "words"], [], items[3], None
    docs, want = [], {}
    for i in range(150):
        body, k = new(rng.randrange(0, 80)), rng.randrange(44)
        if i % 3 and items[k]:
            item = list(items[k])
            if i % 3 == 2 and len(item) > 40:
                item[0] = "changed"
            docs.append(" ".join(body + item + new(5)).upper().replace(" ", rng.choice([" ", ", "])))
            want[i] = k
        else:
            docs.append(" ".join(body))
    docs += [None, "", (1, docs[1])]
    bench = spark.createDataFrame([(i, None if w is None else " ".join(w)) for i, w in items.items()], "item_id long, text string").withColumn("key", F.lit(1))
    frame = docs_of(spark, docs, extra=True)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame, bench).collect()}
    expected = {(i, k) for i, k in want.items()} | {(i, 42) for i, k in want.items() if k == 3} | {(i, 3) for i, k in want.items() if k == 42}
    assert got == expected
    kept = decontaminate.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(152)) - {i for i in want}
    assert decontaminate.leaks(frame, bench.where("false")).count() == 0
    assert decontaminate.leaks(frame.where("false"), bench).count() == 0


def test_fingerprint_radius_holds_similar_windows(spark):
    """Windows of similarity 0.8 or more differ from their item in few enough bits."""
    rng = random.Random(16)
    rows = []
    for i in range(400):
        item = [f"t{rng.randrange(10**5)}" for _ in range(rng.randrange(25, 60))]
        window = list(item)
        for at in rng.choice([(0,), (-1,), (0, -1), (0, 1), (-2, -1)]):
            window[at] = f"v{rng.randrange(10**5)}"
        rows.append((i, item, window))
    frame = spark.createDataFrame(rows, "i long, a array<string>, b array<string>")
    frame = frame.withColumn("sa", decontaminate._shingles("a", F.lit(0))).withColumn("sb", decontaminate._shingles("b", F.lit(0)))
    frame = frame.withColumn("s", decontaminate._similarity("sa", "sb")).where("s >= 0.8")
    frame = frame.withColumn("x", decontaminate._fingerprint("a")).withColumn("y", decontaminate._fingerprint("b"))
    far = frame.agg(F.count("*"), F.count_if(F.expr(f"bit_count(x ^ y) > {decontaminate.RADIUS}"))).first()
    assert far[0] > 100 and far[1] <= far[0] // 100


def test_time_of_personal_data_is_linear_in_matches(spark):
    import time

    many = ["call x@y.zz " * 20_000, "ssn 123-45-6789, " * 5_000, "host 1.2.3.4 " * 20_000]
    docs = docs_of(spark, many)
    pii.with_personal_data(docs).collect()
    begin = time.perf_counter()
    found = {r["doc_id"]: r["spans"] for r in pii.with_personal_data(docs).collect()}
    assert time.perf_counter() - begin < 10
    assert [len(found[i]) for i in range(3)] == [20_000, 5_000, 20_000]
    assert [(s["start"], s["end"]) for s in found[0]] == [(12 * i + 5, 12 * i + 11) for i in range(20_000)]
    assert {s["score"] for s in found[1]} == {0.8} and {s["score"] for s in found[2]} == {0.7}
