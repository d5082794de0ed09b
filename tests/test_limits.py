"""Token queries on whole texts: nothing is cut below the limits of training, and what is longer is cut there."""

from __future__ import annotations

import hashlib

from veriloom.plans import record_queries as R


def _ids(text):
    return [int(hashlib.md5(w.encode()).hexdigest()[:6], 16) for w in text.split()]


def _md5(ids):
    return hashlib.md5(",".join(map(str, ids)).encode()).hexdigest()


_HEAD = "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\n{}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"


def _words(n, c):
    return " ".join(f"{c}{i}" for i in range(n))


def test_sft(spark, tmp_path):
    rows = [(i, "2025-01-01", _words(20, "q"), _words(n, "c"), _words(30, "r")) for i, n in ((0, 300), (1, 10), (16, 9000), (17, 5), (32, 40))]
    spark.createDataFrame(rows, "sft_id long, arrived_at string, question string, complex_cot string, response string").write.parquet(str(tmp_path / "sft.parquet"))
    full = {}
    for i, _, q, c, r in rows:
        prompt = _ids(_HEAD.format(q))
        ids = _ids(_HEAD.format(q) + f"## Thinking\n\n{c}\n\n## Final Response\n\n{r}<|eot_id|>")
        full[i] = [x[-8192:] for x in (ids, [-100] * len(prompt) + ids[len(prompt) :])]
    got = {r.sft_id: (r.n, r.ids, r.labels) for r in R.sft_tokens(spark, str(tmp_path)).collect()}
    assert got == {i: (len(a), _md5(a), _md5(b)) for i, (a, b) in full.items()}
    assert got[0][0] > 256 and got[16][0] == 8192
    width = {b: max(len(full[i][0]) for i in full if i // 16 == b) for b in (0, 1, 2)}
    got = {r.sft_id: (r.n, r.ids, r.labels) for r in R.sft_batches(spark, str(tmp_path)).collect()}
    fill = lambda x, i, pad: x + [pad] * (width[i // 16] - len(x))
    assert got == {i: (width[i // 16], _md5(fill(a, i, 0)), _md5(fill(b, i, -100))) for i, (a, b) in full.items()}


def test_prompts(spark, tmp_path):
    rows = [(i, "2025-01-01", _words(n, "q"), "a") for i, n in ((0, 100), (1, 10), (32, 1500), (33, 900))]
    spark.createDataFrame(rows, "process_id long, arrived_at string, open_question string, gold_answer string").write.parquet(str(tmp_path / "verifiable.parquet"))
    ids = {i: _ids(_HEAD.format(q)) for i, _, q, _ in rows}
    width = {b: min(1000, max(len(x) for i, x in ids.items() if i // 32 == b)) for b in (0, 1)}
    assert width[0] > 64 and width[1] == 1000
    got = {r.process_id: (r.n, r.ids) for r in R.prompt_batches(spark, str(tmp_path)).collect()}
    assert got == {i: (width[i // 32], _md5(([7] * (width[i // 32] - len(x)) + x)[: width[i // 32]])) for i, x in ids.items()}
