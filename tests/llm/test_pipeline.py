"""The pipeline against the plain computations of its stages, and the package's place."""

import os
import subprocess
import sys
from collections import Counter

import corpus_pipeline
import public_tokenizers
from flowlake.llm.mixing import mix
from flowlake.llm.quality import quality
from flowlake.scratch import materialize
from helpers_llm import given, linked, words
from test_tokens import expected
from tokenizers import Tokenizer

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = {d: r[1] for d, r in given(sf_dir).items()}
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf_dir), name)
        if name != "token_files":
            assert out.columns == columns
            rows = out.collect()
            after = {r.doc_id: r.text for r in rows}
            assert all(before[d] == t for d, t in after.items())
        if name == "quality_rules":
            assert set(after) == {r.doc_id for r in quality(docs).filter("kept").collect()}
            assert 0.5 * len(before) < len(after) < len(before)
        elif name == "ngram_jaccard_join":
            assert set(after) == set(linked(before).values())
        elif name == "benchmark_decontamination":
            assert set(after) == {d for d, t in before.items() if not any(b in t for b in bench)}
        elif name == "source_mixing":
            want = Counter({r.doc_id: r.copies for r in mix(docs).collect()})
            assert Counter(r.doc_id for r in rows) == +want
            repeated = sorted((r.doc_id, r.text) for r in rows)
        else:
            tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert sorted(tuple(r) for r in out.collect()) == expected(tokenizer, repeated)
        if name != "token_files":
            docs, before = out, after
    assert sum(len(words(t)) for t in before.values()) > 0


def test_run_gives_the_last_stage(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and rows.count() > 50


def test_library_stands_without_the_package():
    """Nothing outside imports the package, and the entry works where it is absent."""
    for folder, _, names in os.walk(os.path.join(ROOT, "flowlake")):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n)) as f:
                    assert "llm" not in f.read(), n
    code = ("import sys; sys.modules['flowlake.llm'] = None\n"
            "class Gone:\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name in ('flowlake.llm', 'corpus_pipeline') or name.startswith('flowlake.llm.'):\n"
            "            raise ModuleNotFoundError(name, name=name)\n"
            "del sys.modules['flowlake.llm']; sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "assert not any(q.startswith('op') or q == 'pipeline' for q in e.queries()); print(len(e.queries()))")
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout) > 90, out.stderr
