"""The pipeline and the page query on the small tables, against plain Python."""

import hashlib
import html
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from starling.llm import extract, pii, toxicity
from starling.llm.queries import word_tokenizer
from starling.llm.tokens import WordEncoder

from test_corpus import plain_shingles

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")


def one_of_each_group(rows, k, num, den):
    sets = [plain_shingles(r.text, k) for r in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r.doc_id), r.doc_id)
    return [r for i, r in enumerate(rows) if least[root(i)] == r.doc_id]


def mixture(docs):
    """(doc_id, text) of each copy, by a plain water filling and a plain order of hashes."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    own = defaultdict(list)
    for doc_id, source, text in docs:
        own[source].append((hashlib.md5(f"17:{doc_id}".encode()).hexdigest(), size(text), doc_id, text))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(own))}
    sizes = {s: sum(x[1] for x in own[s]) for s in own}
    left, capped = 1.5 * sum(sizes.values()), set()
    while True:
        unit = left / sum(weights[s] for s in own if s not in capped)
        over = {s for s in own if s not in capped and weights[s] * unit > 2 * sizes[s]}
        if not over:
            break
        capped |= over
        left -= sum(2 * sizes[s] for s in over)
    out = []
    for s in own:
        target = 2 * sizes[s] if s in capped else weights[s] * unit
        whole = int(target // sizes[s])
        part = round(target) - whole * sizes[s]
        for _, n, doc_id, text in sorted(own[s]):
            out += [(doc_id, text)] * whole
            if part > 0 and n:
                out.append((doc_id, text if part >= n else " ".join(re.findall(r"[^\x20\x09-\x0D]+", text)[:part])))
                part -= n
    return out


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline

    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    scorer = toxicity.fit(docs, labels).scorer()
    rows = [r for r in docs.collect() if scorer.score(r.text) < 0.7]
    rows = one_of_each_group(rows, 5, 80, 100)
    mixed = mixture([(r.doc_id, r.source, pii.redacted(r.text, pii.find(r.text)[1])) for r in rows])
    want, encoder = Counter(), WordEncoder(word_tokenizer())
    for doc_id, text in mixed:
        ids = np.array([*encoder.library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.update((doc_id, i // 2048, i, len(own := ids[i : i + 2048]), zlib.crc32(own.tobytes())) for i in range(0, len(ids), 2048))
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    at = {}
    for s, o, n in sorted((r.sequence_id, r.offset, r.length) for r in got):
        assert at.get(s, 0) == o
        at[s] = o + n
    assert max(at.values()) <= 2048


def test_stages_keep_the_columns_of_documents():
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "personal_data", "mixing", "packing"]


def test_main_text_equals_the_article(spark):
    pages = spark.read.parquet(f"{MEDIUM}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in extract.main_texts(pages).collect():
        article = source[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b)
