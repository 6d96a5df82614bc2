"""Batch inference with a stand-in judge."""

import hashlib
import json
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from botqa.functions.infer import infer
from botqa.operators import judge as J


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the tasks can't import a test


class HashJudgeClient:
    """Deterministic stand-in judge: the verdict is a function of the prompt's
    SHA-256, in the reply shapes real models produce (plain JSON, fenced JSON,
    prose, or no reply)."""

    TYPES = ["HALLUCINATION", "POLICY_VIOLATION", "INCOMPLETE", "WRONG_ANSWER"]

    def complete(self, prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for p in prompts:
            h = int(hashlib.sha256(p.encode("utf-8")).hexdigest()[:8], 16)
            shape = h % 7
            passed = (h >> 3) % 3 != 0
            body = {"passed": passed, "confidence": round(((h >> 5) % 100) / 100, 2), "reasoning": "auto"}
            if not passed:
                body["failure_type"] = self.TYPES[(h >> 9) % len(self.TYPES)]
            if shape == 0:
                out.append(None)
            elif shape == 1:
                out.append("I could not evaluate this response.")
            elif shape == 2:
                out.append("```json\n" + json.dumps(body) + "\n```")
            else:
                out.append(json.dumps(body))
        return out


def test_every_prompt_gets_its_reply(spark):
    prompts = spark.range(300).select(F.col("id").alias("scenario_id"), F.lit(0).alias("slot"), F.lit("m").alias("judge_model"),
                                      F.concat(F.lit("p"), F.col("id")).alias("prompt")).repartition(5)
    rows = infer(prompts, "prompt", "raw", HashJudgeClient, batch_size=7).collect()
    want = dict(zip([f"p{i}" for i in range(300)], HashJudgeClient().complete([f"p{i}" for i in range(300)])))
    assert {r["prompt"]: r["raw"] for r in rows} == want and any(v is None for v in want.values())
    assert infer(prompts.limit(0), "prompt", "raw", HashJudgeClient).count() == 0
    verdicts = J.parse_verdicts(infer(prompts, "prompt", "raw", HashJudgeClient).drop("prompt"))
    assert verdicts.where("valid").count() == sum(v is not None and "{" in v for v in want.values())
