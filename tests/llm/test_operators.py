import hashlib
import html.parser
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from docketry.llm import bpe, chat, decontam, images, langid, mainext, quality, sharding, warc
from docketry.llm.common import new_path

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string"
ODD = [(1, "The cat is on the mat. " * 30, "en", "src0"), (2, None, None, None), (3, "", "en", "src0"), (4, "é" * 5000, "fr", "src1"), (1, "The cat is on the mat. " * 30, "en", "src0"), (None, "x y", "de", "src2"), (7, " \n\t", "xx", "src0")]


def clashing(df):
    """The same rows with columns named like those that operators add."""
    return df.select("*", *[F.lit(1).alias(c) for c in ("id", "size", "n", "score", "shard", "component", "key", "host", "evidence")])


@pytest.fixture(scope="module")
def odd(spark):
    return clashing(spark.createDataFrame(ODD, DOCS))


@pytest.fixture(scope="module")
def none(spark):
    return clashing(spark.createDataFrame([], DOCS))


# sharding


def test_shards_are_a_permutation(spark, odd, none):
    rows = sharding.feistel_shards(odd.union(odd), n_shards=4).collect()
    n = 2 * len(ODD)
    assert sorted(r.position for r in rows) == list(range(n)) and sorted(r.row_number for r in rows) == list(range(n))
    for shard in range(4):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots))) and len(slots) in (n // 4, n // 4 + 1)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in ODD + ODD)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    assert sharding.feistel_shards(none).count() == 0


def test_shards_dont_depend_on_partitions(spark, odd):
    a = {tuple(r) for r in sharding.feistel_shards(odd.repartition(5)).collect()}
    assert a == {tuple(r) for r in sharding.feistel_shards(odd.coalesce(1)).collect()}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 1000])
def test_permutation_and_inverse(spark, n):
    rows = spark.range(n).select("id", sharding.permuted(F.col("id"), n, 3).alias("p")).select("id", "p", sharding.permuted(F.col("p"), n, 3, True).alias("back"))
    rows = rows.collect()
    assert sorted(r.p for r in rows) == list(range(n)) and all(r.id == r.back for r in rows)


def hashed(*values):
    """Spark's xxhash64 of longs and ints (pairs of a value and its format); nulls leave the hash as it is."""
    h = 42
    for v, form in values:
        h = h if v is None else xxhash.xxh64(struct.pack(form, v), seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def placed(x, n, seed):
    """The permutation in plain Python: passes of the network until the place lies below n."""
    a = math.isqrt(max(n - 1, 0)) + 1
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for r in range(sharding.ROUNDS):
            if r % 2 == 0:
                left = (left + hashed((right, "<q"), (r, "<i"), (seed, "<i")) % a) % a
            else:
                right = (right + hashed((left, "<q"), (r, "<i"), (seed, "<i")) % b) % b
        x = left * b + right
        if x < n:
            return x


def test_shards_are_recomputed(spark, odd):
    """Row numbers, places, shards and slots of all rows against plain Python, and the closed formulas both ways."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    frame = docs.unionByName(odd.select("doc_id", "text"))
    keys = [(r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in frame.collect()]
    keys.sort(key=lambda k: (hashed(*[(v, "<q") for v in k]) % 4096, k[0] is not None, k))
    n = len(keys)
    want = Counter((*k, i, placed(i, n, 5) % 7, placed(i, n, 5) // 7) for i, k in enumerate(keys))
    got = sharding.feistel_shards(frame, n_shards=7, seed=5)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.row_number, r.shard, r.slot) for r in got.collect()) == want
    shard, slot = sharding.locate(F.col("row_number"), n, 7, 5)
    rows = got.select("row_number", "shard", "slot", shard.alias("to_shard"), slot.alias("to_slot"), sharding.row_at(F.col("shard"), F.col("slot"), n, 7, 5).alias("back")).collect()
    assert all((r.to_shard, r.to_slot, r.back) == (r.shard, r.slot, r.row_number) for r in rows)


def test_many_copies_of_one_row(spark):
    frame = spark.range(25_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    rows = sharding.feistel_shards(frame, n_shards=7)
    assert rows.count() == 25_000 and rows.select("position").distinct().count() == 25_000


def test_write_shards(spark, odd):
    path = new_path(spark, "shards")
    sharding.write_shards(odd, sharding.feistel_shards(odd, n_shards=3), path)
    back = spark.read.parquet(path)
    assert sorted((r.doc_id or 0, r.text or "") for r in back.collect()) == sorted((i or 0, t or "") for i, t, *_ in ODD)


# decontamination


def brute_leaks(docs, items):
    """BM25 over every pair of passage and item, without an index."""
    index = decontam.Index([i for i, _ in items], [t for _, t in items])
    tokens = [decontam.terms([t])[0].tolist() for _, t in items]
    df, mean = Counter(w for t in tokens for w in set(t)), np.mean([len(t) for t in tokens])

    def scores(query):
        out = []
        for t in tokens:
            tf = Counter(t)
            out.append(sum(math.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in set(query) if w in tf))
        return out

    own = [scores(t)[k] for k, t in enumerate(tokens)]
    out = set()
    for d, text in docs:
        w, half = decontam.terms([text or ""])[0].tolist(), index.width
        for p in range(max(1, -(-len(w) // half) - 1) if w else 0):
            span = w[p * half : (p + 2) * half]
            grams = {tuple(span[k : k + 3]) for k in range(len(span))}
            for k, s in enumerate(scores(span)):
                share = []
                for part in decontam.question_and_answer(items[k][1]):
                    q = decontam.terms([part])[0].tolist()
                    own_grams = {tuple(q[j : j + 3]) for j in range(len(q) - 2)}
                    share.append(len(own_grams & grams) / len(own_grams) if own_grams else 1)
                if s / own[k] >= 0.5 and share[0] >= 0.6 and share[1] >= 0.5:
                    out.add((d, items[k][0]))
    return out


def test_leaks_match_brute_force(spark, odd, none):
    rng = random.Random(4)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"
    sentence = lambda n: (" ".join(word() for _ in range(n)) + ".").capitalize()
    items = [(k, f"{sentence(rng.randrange(8, 25))} {sentence(rng.randrange(4, 15))}") for k in range(30)]
    docs = []
    for d in range(80):
        text = [sentence(rng.randrange(5, 30)) for _ in range(rng.randrange(1, 30))]
        if d % 3 == 0:
            leak = items[d % 30][1].split()
            for _ in range(d % 9):
                leak[rng.randrange(len(leak))] = word()
            text.insert(rng.randrange(len(text) + 1), " ".join(leak).upper())
        docs.append((d, " ".join(text)))
    bench = spark.createDataFrame([*items, (99, None), (98, "?!")], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(frame, bench).collect()}
    assert got == brute_leaks(docs, items) and len(got) > 10
    clean = {r.doc_id for r in decontam.without_leaks(frame, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in got}
    # more indexes: the same statistics, so the same hits
    parts = decontam.find_leaks(frame, bench, index_bytes=600).collect()
    assert len(list(decontam.indexes(bench, 600))) > 3 and sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in parts) == sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in decontam.find_leaks(frame, bench).collect())
    assert {r.doc_id for r in decontam.without_leaks(frame, bench, index_bytes=600).collect()} == clean
    assert decontam.find_leaks(odd, bench).count() == 0 and decontam.without_leaks(odd, bench).columns == odd.columns
    assert decontam.find_leaks(none, bench).count() == 0 and decontam.find_leaks(frame, bench.limit(0)).count() == 0


# WARC


def test_archives_come_back(spark):
    page = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 9
    rows = [(3, "u3", page), (1, "u1", page), (1, "u1", page), (2, None, None), (5, "a\r\nX: y", "short"), (6, "u6", "short"), (None, "u", page), (9, "u9", "x" * 200_000)]
    frame = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, digest string")
    path = new_path(spark, "warc")
    warc.write_archives(frame, path)
    read = warc.read_archives(spark, path)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolve_revisits(read).collect())
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        again = h == page and i != 1
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 1 if again else None] += 1
    assert got == want
    assert {r.payload for r in read.where("row_id = 9").collect()} == {"x" * 200_000}
    raw = [r.value for r in spark.read.text(path).where("value LIKE 'WARC-Record-ID: %'").collect()]
    assert len(raw) == len(set(raw)) == len(rows)
    empty = new_path(spark, "warc")
    warc.write_archives(frame.limit(0), empty)
    assert warc.resolve_revisits(warc.read_archives(spark, empty)).count() == 0


# HTML


@pytest.mark.parametrize("page, text", [
    ("", ""),
    (None, ""),
    ("<article><h1>T</h1><p>a  b&nbsp;c &lt;x&gt;</p><aside>no</aside><p>d<br>e</p></article><footer>f</footer>", "T\na b c <x>\nd e"),
    ("<body><nav><a href=1>Home</a></nav><div class='cookie-notice'>We use cookies</div><div><p>" + "the cat is on the mat and so on " * 8 + "</p><p>Short.</p></div><div id=comments><p>" + "the reader is of the view that it is so " * 8 + "</p></div></body>", ("the cat is on the mat and so on " * 8).strip() + "\nShort."),
    ("<script>var t='</p>'</script><p>one<p>two", "one\ntwo"),
    ("<form>Name <input></form><p>only text", "only text"),
    ("<main><p>x</p><div style='display:none'>y</div><ul><li>z</li></ul></main>", "x\nz"),
    ("<div class='content has-sidebar'><p>" + "the cat is on the mat and so on " * 8 + "</p></div>", ("the cat is on the mat and so on " * 8).strip()),
    ("<p>x <span class='ad'>buy <span>now</span> cheap</span> y</p>", "x y"),
    ("<p>x <span class=ad>left open</p><p>y</p>", "x\ny"),
    ("<article><p>a <math><mi>x</mi></math></p><p class='foot-note'>note</p></article>", "a x\nnote"),
    ("<div id='page' class='with-banner'><article><p>in</p></article></div>", "in"),
    ("<section class='comment-free no-ads'><p title='hidden valley' data-hidden='false'>text</p></section>", "text"),
    ("<div class=sidebar><article><p>held</p><div class=comments>no</div></article></div><p>out</p>", "held"),
])
def test_main_text(page, text):
    assert mainext.main_text(page or "") == text


class Plain(html.parser.HTMLParser):
    """The blocks of articles by element names alone, as a second way to the text of the given pages."""

    def __init__(self, page):
        super().__init__()
        self.open, self.blocks, self.text = [], [], ""
        self.feed(page)

    def flush(self, tag):
        if tag in mainext.BLOCK:
            keep = any(t in mainext.SECTION for t, _ in self.open) and not any(bad for _, bad in self.open)
            self.blocks += [" ".join(self.text.split())] if keep and self.text.strip() else []
            self.text = ""

    def handle_starttag(self, tag, attributes):
        self.flush(tag)
        if tag == "br":
            self.text += " "
        if tag == "p" and self.open and self.open[-1][0] == "p":
            self.open.pop()
        if tag not in mainext.VOID:
            marked = any(w in mainext.NOISE for k, v in attributes if k in ("class", "id", "role") for w in (v or "").lower().replace("-", " ").split())
            self.open.append((tag, marked or tag in mainext.ASIDE or tag in mainext.DROPPED or ("style", "display:none") in attributes))

    def handle_endtag(self, tag):
        self.flush(tag)
        if tag in [t for t, _ in self.open]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(t in mainext.DROPPED for t, _ in self.open):
            self.text += data


STORY = "The story is about the way that the river was crossed by the people of the town, and it was told to them by those who had seen it with their own eyes on the day. " * 3
REMARK = "I think that this is the best that was written about the river and the town in all of the years that I have been a reader of it, and I was there on the day. " * 5


@pytest.mark.parametrize("beside", [
    '<ol class="comment-list"><li><article class="comment-body"><p>{}</p></article></li></ol>',
    '<div class="related"><article><p>{}</p></article><article><p>{}</p></article></div>',
    '<article class="comment"><p>{}</p></article>',
    '<section id="comments"><article><header>Ann</header><p>{}</p></article></section>',
    '<div class="sidebar"><main2><article><p>{}</p></article></main2></div>',
])
@pytest.mark.parametrize("whole", ["<article><h1>On the river</h1><p>{}</p></article>{}", "<main><article><p>{}</p></article>{}</main>", '<div class="page sidebar-wrap"><article><p>{}</p></article>{}</div>', "{1}<article class='post related-story'><p>{0}</p></article>"])
def test_articles_of_readers_and_teasers_are_no_main_text(beside, whole):
    if "related-story" in whole and 'class="comment"' in beside:
        return  # two named articles side by side: the larger one can't be told from the page's
    text = mainext.main_text("<html><body>" + whole.format(STORY, beside.format(REMARK, REMARK)) + "</body></html>")
    assert "story is about" in text and "best that was written" not in text


def test_main_text_equals_a_plainer_extractor(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in mainext.extract_main_text(pages).collect()}
    same = [got[r.page_id] == "\n".join(Plain(r.html).blocks) for r in pages.collect() if "<article" in (r.html or "")]
    assert len(same) > 100 and np.mean(same) >= 0.95, np.mean(same)


def test_main_text_of_tables(spark):
    frame = spark.createDataFrame([(1, "u", None, "t"), (2, None, "<p>a</p>", "t"), (2, None, "<p>a</p>", "t")], "page_id long, url string, html string, text string")
    assert [tuple(r) for r in mainext.extract_main_text(frame).orderBy("page_id").collect()] == [(1, "u", "", 0), (2, None, "a", 1), (2, None, "a", 1)]
    assert mainext.extract_main_text(frame.limit(0)).count() == 0


def test_broken_markup_takes_linear_time():
    for page in ("<" * 50_000, "<div " * 20_000, "<p>" * 20_000, "<a href='" * 5_000):
        mainext.main_text(page)


# BPE


def test_bpe_equals_the_library(spark, odd, none):
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(WORDS), random.Random(2)
    pool = "aAbB éÉïİıẞΣσς'’\"sStTdDlLmMvVrRe 0129٣½²\t\n\r\x1c\x1f\x85\xa0 <|>endoftextstart漢字カ한🙂🏽́ﬁ‍­"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["a" * 3000, "<|endoftext|>A<|startoftext|>b", "it's they'll", ""]
    encode = bpe.Encoder(bpe.load(WORDS))
    for text, (ids, decoded, n) in zip(texts, encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and n == len(want) and decoded == library.decode(want, skip_special_tokens=False)
    rows = bpe.bpe_encode(odd, WORDS).collect()
    assert len(rows) == len(ODD) and {r.n_tokens for r in rows if r.doc_id in (2, 3, 7)} == {0}
    assert bpe.bpe_encode(none, WORDS).count() == 0


# chat


def test_escapes_are_reversible():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice([*chat.CONTROLS, "\\", "<", "[", "x", "\n", "é"]) for _ in range(rng.randrange(8)))
        assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROLS)


def test_conversations_come_back(spark, monkeypatch):
    rows = [(1, 0, "user", "a</s>"), (1, 1, "assistant", "\n b🙂\\"), (1, 1, "assistant", "\n b🙂\\"), (2, 0, None, None), (2, 1, "assistant", ""), (None, 0, "a\nb", "c"), (3, None, "assistant", "z"), (3, 0, "system", "y" * 3000)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string")
    for limit in (10**6, 10):
        got = {r.conv_id: r for r in chat.conversation_digests(frame, BYTES).collect()}
        assert set(got) == {1, 2, 3, None}
        for c in got:
            turns = sorted(((-1 if t is None else t), r or "", x or "") for i, t, r, x in rows if i == c)
            loss = "".join(x for _, r, x in turns if r == "assistant")
            assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
            assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
            assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        monkeypatch.setattr(chat, "PART_CHARS", limit)
    assert chat.format_conversations(frame, BYTES).select("conv_id").distinct().count() == 4
    assert chat.conversation_digests(frame.limit(0), BYTES).count() == 0


# images


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(0)
    return [(i, [float(x) for x in rng.normal(size=16)], "t") for i in range(160)]


def drawn(vectors):
    """Pictures and edited copies as ``media_of`` draws them."""
    out = {}
    for i, v, _ in vectors:
        out[2 * i] = images.picture(np.array(v))
        if i % 4 == 0:
            out[2 * i + 1] = images.edited(out[2 * i], i // 4)
    return {i: images.describe(images.from_pgm(images.to_pgm(p)), images.chosen_tests()) for i, p in out.items()}


def test_edited_copies_match_brute_force(spark, vectors):
    """All pairs of pictures, all their descriptors: the tables lose no link that these have."""
    packed = {i: (s, np.frombuffer(np.packbits(b, axis=1).tobytes(), dtype=np.uint64).reshape(-1, 4)) for i, (s, b) in drawn(vectors).items()}
    want, ids = set(), sorted(packed)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            i, j = images.matches(packed[a][1], packed[b][1])
            if len(i) >= images.CONSENSUS and images.consensus(packed[a][0][i], packed[b][0][j]) >= images.CONSENSUS:
                want.add((a, b))
    assert want == {(2 * i, 2 * i + 1) for i in range(0, 160, 4)}
    media = images.media_of(spark.createDataFrame(vectors, "vec_id long, embedding array<float>, id string"))
    for small in (images.SMALL, 1):
        got = {r.media_id: (r.component_id, r.n_links) for r in images.image_copies(media, small=small).collect()}
        links = {(a, b) for a, b in want if got[a] == got[b] == (a, 1)}
        assert len(links) >= 0.95 * len(want) and set(got) == set(ids)
        assert all(c == (i & ~1 if i % 8 < 2 else i) for i, (c, _) in got.items() if i % 8 >= 2 or (i & ~1, i | 1) in links)


def test_odd_images(spark, vectors):
    rows = vectors[:9] + [(100, None, "t"), (101, [], "t"), (102, vectors[1][1], "t")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    got = {r.media_id: r for r in images.image_copies(images.media_of(frame)).collect()}
    assert got[204].component_id == 2 and got[200].component_id == 200 and got[202].n_links == 0
    broken = spark.createDataFrame([(1, b"P5\n9 9\n255\nabc"), (2, b""), (3, None), (None, images.to_pgm(np.full((50, 50), 7)))], "media_id long, image binary")
    assert sorted((tuple(r) for r in images.image_copies(broken).collect()), key=str) == [(1, 1, 0), (2, 2, 0), (3, 3, 0), (None, None, 0)]
    assert images.image_copies(broken.limit(0)).count() == 0


def test_many_copies_of_one_picture(spark):
    """Large buckets: copies of one picture in all shades, beside one of another with equal corners."""
    rng = np.random.default_rng(3)
    one, other = images.picture(rng.normal(size=4)), images.picture(rng.normal(size=4))
    shown = [one * (0.5 + k / 200) for k in range(90)] + [other, other * 0.9]
    frame = spark.createDataFrame([(i, bytearray(images.to_pgm(p))) for i, p in enumerate(shown)], "media_id long, image binary")
    got = {r.media_id: r.component_id for r in images.image_copies(frame, small=8).collect()}
    assert got == {i: 0 for i in range(90)} | {90: 90, 91: 90}


def test_all_links_in_large_buckets_are_found(spark):
    """Links of a picture's many copies among themselves, too, held against all pairs by brute force."""
    rng = np.random.default_rng(3)
    one = images.picture(rng.normal(size=4))
    shown = [images.to_pgm(one * (0.5 + k / 60)) for k in range(30)]
    made = [images.describe(images.from_pgm(p), images.chosen_tests()) for p in shown]
    packed = [(s, np.frombuffer(np.packbits(b, axis=1).tobytes(), dtype=np.uint64).reshape(-1, 4)) for s, b in made]
    want = [0] * len(shown)
    for a in range(len(shown)):
        for b in range(a + 1, len(shown)):
            i, j = images.matches(packed[a][1], packed[b][1])
            if images.consensus(packed[a][0][i], packed[b][0][j]) >= images.CONSENSUS:
                want[a], want[b] = want[a] + 1, want[b] + 1
    # a repeated row is no link
    for rows, small in ((list(enumerate(shown)), 7), ([*enumerate(shown), (4, shown[4])], images.SMALL)):
        frame = spark.createDataFrame([(i, bytearray(p)) for i, p in rows], "media_id long, image binary")
        got = sorted(tuple(r) for r in images.image_copies(frame, small=small).select("media_id", "component_id", "n_links").distinct().collect())
        assert got == [(i, 0, n) for i, n in enumerate(want)]


@pytest.mark.parametrize(("gather", "small"), [(1, 4), (10, 1), (10, 4), (10, 8), (10, 64), (100_000, 4)])
def test_every_pair_of_a_bucket_is_formed_once(spark, monkeypatch, gather, small):
    """Wherever batches and blocks end."""
    buckets = {k: [i * 7 + k for i in range(n)] for k, n in {1: 3, 2: 40, 5: 1, 6: 8, 7: 9, 9: 25}.items()}
    monkeypatch.setattr(images, "GATHER", gather)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = spark.conf.get(batch)
    spark.conf.set(batch, "6")
    try:
        met = images._meetings(spark.createDataFrame([(k, i) for k, ids in buckets.items() for i in ids], "key long, id long").coalesce(1), small).persist()
        large = met.where("key IS NOT NULL").select("key", "block", F.col("a").alias("id"))
        assert {r.key for r in large.collect()} == {k for k, ids in buckets.items() if len(ids) > small}
        assert all(r["count"] <= small for r in large.groupBy("key", "block").count().collect())
        found = met.where("key IS NULL").select("a", "b").unionByName(images._block_pairs(large)).collect()
    finally:
        spark.conf.set(batch, rows)
        met.unpersist()
    assert sorted(map(tuple, found)) == sorted((a, b) for ids in buckets.values() for k, a in enumerate(ids) for b in ids[k + 1 :])


def test_crops_of_photos_and_small_copies_are_linked(spark):
    rng = np.random.default_rng(8)
    photo, *plain = (128 + sum(images.resize(rng.normal(0, 30, (n, n)).astype(np.float32), side, side) for n in (side // 10, side // 5, side // 3)).clip(-128, 127) for side in (384, 96, 96))
    quarter, small, tiny = photo[150:342, 30:222], images.resize(plain[0], 40, 40), images.resize(plain[1][:50, :50], 27, 27)
    shown = [photo, quarter, plain[0], small, plain[1][:50, :50], tiny]
    frame = spark.createDataFrame([(i, bytearray(images.to_pgm(p))) for i, p in enumerate(shown)], "media_id long, image binary")
    got = {r.media_id: r.component_id for r in images.image_copies(frame).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


# language


def test_evidence_is_fused(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.learn(docs)
    found = langid.identify(langid.documents_as_rows(docs), model).select(F.col("id").alias("doc_id"), F.col("lang").alias("found"), "accepted")
    assert found.join(docs, "doc_id").where("found = lang AND accepted").count() >= 0.97 * docs.count()
    got = langid.identify(langid.documents_as_rows(odd), model).collect()
    assert len(got) == len(ODD) and all(0 < r.probability <= 1 for r in got)
    assert langid.identify(langid.documents_as_rows(none), model).count() == 0
    pages = spark.createDataFrame([(1, "http://h.example.de/x", "<html lang='de'><p></p>"), (2, "http://h.example.com/fr/1", ""), (3, None, None), (4, "http://h.example.com/1", "<p>" + "Ελληνικά " * 30)], "page_id long, url string, html string")
    by = {r.id: r for r in langid.identify(langid.pages_as_rows(pages), model).collect()}
    assert by[1].lang == "de" and by[1].accepted and by[2].lang == "fr" and not by[4].accepted


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.learn(docs.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1 AND n_chars > 100")
    got = {r.id: r.lang for r in langid.identify(langid.documents_as_rows(rest), model).collect()}
    right = [got[r.doc_id] == r.lang for r in rest.collect()]
    assert np.mean(right) >= 0.97


def test_posterior_is_recomputed(spark):
    """The fused posterior of every page against sums in plain Python."""
    model = langid.learn(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    pages = langid.pages_as_rows(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    got = {r.id: (r.lang, r.probability) for r in langid.identify(pages, model).collect()}
    names, rows = langid.LANGUAGES, pages.collect()
    share, by_host, by_domain = {}, {}, {}
    for r in rows:
        log = langid.text_evidence([r.text], model)[0][0].astype(float)
        for said, p in ((r.declared, langid.DECLARED), (r.suffix, langid.SUFFIX)):
            if said in names:
                log = log + np.log([p if n == said else (1 - p) / (len(names) - 1) for n in names])
        e = np.exp(log - log.max())
        share[r.id] = (log, e / e.sum())
        by_host.setdefault(r.host, []).append(r.id)
        by_domain.setdefault(".".join(r.host.split(".")[-2:]), []).append(r.id)
    sums = lambda ids: sum(share[i][1] for i in ids)
    top = (sums(share) + 1) / (len(rows) + len(names))
    for r in rows:
        domain = by_domain[".".join(r.host.split(".")[-2:])]
        prior = (sums(domain) + langid.DOMAIN_ROWS * top) / (len(domain) + langid.DOMAIN_ROWS)
        host = by_host[r.host]
        score = share[r.id][0] + np.log((np.maximum(sums(host) - share[r.id][1], 0) + langid.HOST_ROWS * prior) / (len(host) - 1 + langid.HOST_ROWS))
        e = np.exp(score - score.max())
        assert got[r.id][0] == names[int(e.argmax())] and abs(got[r.id][1] - e.max() / e.sum()) < 1e-5


# quality


def test_held_out_accuracy(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train_quality(docs, labels)
    rows = quality.score_quality(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    got = quality.score_quality(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.only_good(odd, model).columns == odd.columns and quality.score_quality(none, model).count() == 0


def test_fit_is_the_optimum():
    """The pairwise logistic loss, written out, rises from the fitted weights in every direction."""
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "BUY", "now!!", "on"], 40, p=p)) for p in ([0.3, 0.2, 0.2, 0.05, 0.05, 0.2], [0.2, 0.1, 0.1, 0.25, 0.25, 0.1]) for _ in range(60)]
    x, good = quality.features(texts), np.repeat([1, 0], 60)
    model = quality.fit_pairs(x, good, pairs=3000)
    z, pairs = quality.standard(x, model.mean, model.scale), np.random.default_rng(7)
    diff = z[pairs.choice(np.flatnonzero(good == 1), 3000)] - z[pairs.choice(np.flatnonzero(good == 0), 3000)]
    loss = lambda w: np.mean([math.log1p(math.exp(-d)) for d in diff @ w]) + 0.5e-3 * (w @ w)
    least = loss(model.weight)
    for k in range(0, len(model.weight), 7):
        for by in (-1e-2, 1e-2):
            other = model.weight.copy()
            other[k] += by
            assert loss(other) > least
    assert quality.features(["x", ""]).shape == quality.features(texts[:2]).shape and quality.features([]).shape[1] == x.shape[1]


def test_training_without_labels(spark, none):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.train_quality(none, labels)
    assert quality.features([]).shape[0] == 0 and (model.score(quality.features(["x"])) >= quality.CUT).all()
