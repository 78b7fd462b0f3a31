"""The Merkle manifest against a plain tree in Python."""

import hashlib
import zlib

import pytest

from corpusmill.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place int, n string"


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return levels


def plain_proof(levels, i, fanout):
    """(nodes before it, the others) of each run on the way up."""
    out = []
    for nodes in levels[:-1]:
        begin = i // fanout * fanout
        run = nodes[begin : begin + fanout]
        out.append((i - begin, "".join(run[: i - begin] + run[i - begin + 1 :])))
        i //= fanout
    return out


def plain(rows, fanout=2):
    trees = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        trees.setdefault(lang, []).append((doc_id, leaf(doc_id, text, lang, source, n_chars), text, source, n_chars))
    langs = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    for lang in langs:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    built = {lang: plain_tree([r[1] for r in trees[lang]], fanout) for lang in langs}
    top = plain_tree([built[lang][-1][0] for lang in langs], fanout) if langs else [[None]]
    out = []
    for k, lang in enumerate(langs):
        for i, (doc_id, own, text, source, n_chars) in enumerate(trees[lang]):
            proof = plain_proof(built[lang], i, fanout) + plain_proof(top, k, fanout)
            bad = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            found = leaf(doc_id, text, lang, source, n_chars + 1) if bad else own
            for left, others in proof:
                found = h(others[: 64 * left] + found + others[64 * left :])
            out.append((doc_id, own, built[lang][-1][0], top[-1][0], h("".join(o for _, o in proof)), found, found == top[-1][0]))
    return sorted(out, key=repr)


def rows_of(n):
    rows = [(i, f"text {i} é\n" * (i % 4), ["en", "en", "en", "fr", "zz"][i % 5], ["a", None, "b"][i % 3], None if i % 11 == 0 else i, i, "x") for i in range(n)]
    rows += [(None, None, None, None, None, 1, "x"), (None, "", None, "s", 3, 1, "x"), (4, "other", "en", "a", 9, 1, "x"), (7, None, "fr", "b", None, 1, "x")]
    rows += [rows[5], rows[5], (1_000_000, "w " * 400_000, "de", "long", 800_000, 1, "x"), (2, "t", "", "", 1, 2, "x"), (-3, "t", "éé", "", 1, 2, "x")]
    return rows


def found(manifest):
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in manifest.checked().collect()], key=repr)


@pytest.mark.parametrize(("n", "fanout", "block"), [(60, 2, 4), (61, 3, 3), (23, 5, 30)])
def test_as_a_plain_tree(spark, n, fanout, block):
    """Blocks of few leaves make several rounds, of the languages too; nulls, repeats, a long text and clashing columns."""
    rows = rows_of(n)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(merkle.Manifest(docs, fanout, block, merkle.tampering(docs))) == plain(rows, fanout)


def test_proofs_fold_to_the_root(spark):
    rows = rows_of(40)
    manifest = merkle.Manifest(spark.createDataFrame(rows, SCHEMA), 3, 9)
    proofs = manifest.proofs().collect()
    assert len(proofs) == len(rows)
    for p in proofs:
        assert merkle.fold(p.leaf, p.lefts, p.runs) == manifest.root != merkle.fold(h("another"), p.lefts, p.runs)
    assert {r.lang for r in manifest.subroots.collect()} == {r[2] for r in rows}


def test_one_document_and_none(spark):
    docs = spark.createDataFrame([(1, "t", "en", "s", 1, 1, "x")], SCHEMA)
    one = found(merkle.Manifest(docs, altered=merkle.tampering(docs)))
    own = leaf(1, "t", "en", "s", 1)
    assert one == [(1, own, own, own, h(""), own, True)]
    none = merkle.Manifest(docs.limit(0))
    assert none.root is None and none.checked().collect() == [] and none.proofs().collect() == []


def test_a_language_of_most_rows_is_cut_into_blocks(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'t' AS text", "IF(id % 50 = 0, 'fr', 'en') AS lang", "'s' AS source", "1L AS n_chars")
    manifest = merkle.Manifest(docs, block=64)
    assert manifest.leaves.groupBy("tree", "block").count().agg({"count": "max"}).first()[0] == 64
    assert manifest.checked().filter("verified").count() == 3000
    with pytest.raises(ValueError):
        merkle.Manifest(docs, fanout=1)
