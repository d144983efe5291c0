"""The pipeline's stages, each against a brute-force version on its own input."""

from collections import Counter

import corpus_pipeline
from plotwright.llm import bpe, mixing
from test_llm import brute_lines, components

DATA = "/root/testdata/sf0.001"


def survivors(rows):
    """Ids of one document of each group by the Jaccard similarity of five-word shingles."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = [(a, b) for a in range(len(rows)) for b in range(a) if not sets[a] | sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    least = {}
    for n, root in components(links, range(len(rows))).items():
        least[root] = min(least.get(root, rows[n][0]), rows[n][0])
    return sorted(least.values())


def test_each_stage_on_its_input(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, frames = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        frames[name] = docs.collect()
        out = stage(spark, docs, DATA)
        assert i == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    last = docs.collect()
    assert len(frames["line_dedup"]) >= 0.98 * len(frames["language"])
    assert sorted((x.doc_id, x.text) for x in frames["near_dedup"]) == sorted(brute_lines([(x.doc_id, x.text) for x in frames["line_dedup"]]))
    assert all(x.n_chars == len(x.text) for x in frames["near_dedup"])
    assert sorted(x.doc_id for x in frames["mix"]) == survivors([(x.doc_id, x.text) for x in frames["near_dedup"]])
    size = {x.doc_id: len(x.text.encode().split()) for x in frames["mix"]}
    source = {x.doc_id: x.source for x in frames["mix"]}
    copies = Counter(x.doc_id for x in frames["tokens"])
    assert max(copies.values()) <= 3
    for s, t in mixing.targets({s: sum(size[d] for d in size if source[d] == s) for s in set(source.values())}).items():
        mine = [d for d in size if source[d] == s]
        assert abs(sum(copies[d] * size[d] for d in mine) - t) <= max(size[d] for d in mine)
    library = Tokenizer.from_file(bpe._path(None))
    assert len(last) == sum(copies.values()) and all(x.round_trip for x in last)
    assert all(x.token_ids == library.encode(x.text, add_special_tokens=False).ids for x in last)


def test_sql_is_none_or_text():
    assert corpus_pipeline.ORACLE_SQL is None or isinstance(corpus_pipeline.ORACLE_SQL, str)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "mix", "tokens"]
