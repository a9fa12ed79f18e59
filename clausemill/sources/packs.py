"""Packs of the deep analysis as tables: phrases of signals, rules with keywords, weights of features, thresholds.

A pack is a JSON object that a user brings; the starter pack is one of them. Features of a candidate are the numbers of
phrases of each signal, and role, subject, num, mon, norm_mon (see deep_pack), one (always 1), and total in thresholds.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import deep_pack as P

EXTRA = ("one", "role", "subject", "num", "mon", "norm_mon")
MOST_BYTES = 16 << 20


@dataclass(frozen=True)
class Pack:
    """signals: phrases by name. rules, disputes: objects with rule_id, severity (of rules), keywords, weights, thresholds."""

    signals: dict
    rules: list
    disputes: list

    def features(self) -> list[str]:
        """Names by place in a candidate's row of features; total, of which only thresholds know, comes last."""
        return [*self.signals, *EXTRA, "total"]

    def problems(self) -> list[str]:
        """What is wrong with the pack; nothing where it can be used."""
        known, out = set(self.features()), []
        for kind in ("rules", "disputes"):
            seen: set = set()
            for r in getattr(self, kind):
                name = r.get("rule_id")
                if not name or name in seen:
                    out.append(f"{kind}: {name!r} has no name of its own")
                seen.add(name)
                if kind == "rules" and r.get("severity") not in ("low", "medium", "high"):
                    out.append(f"{name}: severity {r.get('severity')!r}")
                if not r.get("keywords") or not all(r["keywords"]):
                    out.append(f"{name}: keywords are missing or empty")
                conditions = [c for w in r.get("weights", ()) for c in w.get("when", ())]
                for w in [*r.get("weights", ()), *conditions]:
                    if w.get("feature") not in known - {"total"}:
                        out.append(f"{name}: feature {w.get('feature')!r}")
                for any_of in r.get("thresholds", ()):
                    out += [f"{name}: feature {t.get('feature')!r}" for t in any_of if t.get("feature") not in known]
        out += [f"signal {n}: no phrases" for n, phrases in self.signals.items() if not phrases or not all(phrases)]
        return out

    def weights(self, spark: SparkSession, kind: str) -> DataFrame:
        """(rule_id, at, weight, cap, when): a row per term of a score; at is the feature's place."""
        at = {n: i for i, n in enumerate(self.features())}
        rows = [(r["rule_id"], at[w["feature"]], int(w["weight"]), w.get("cap"), [(at[c["feature"]], c.get("at_least"), c.get("at_most")) for c in w.get("when", ())])
                for r in getattr(self, kind) for w in r.get("weights", ())]
        return spark.createDataFrame(rows, "rule_id string, at int, weight int, cap int, when array<struct<at:int,at_least:int,at_most:int>>")

    def thresholds(self, spark: SparkSession, kind: str) -> DataFrame:
        """(rule_id, clause, at, at_least, at_most): a rule passes where of each clause one row is met."""
        at = {n: i for i, n in enumerate(self.features())}
        rows = [(r["rule_id"], i, at[t["feature"]], t.get("at_least"), t.get("at_most")) for r in getattr(self, kind) for i, any_of in enumerate(r.get("thresholds", ())) for t in any_of]
        return spark.createDataFrame(rows, "rule_id string, clause int, at int, at_least int, at_most int")

    def as_json(self) -> str:
        return json.dumps({"signals": self.signals, "rules": self.rules, "disputes": self.disputes}, ensure_ascii=False, indent=1)


def from_json(text: str) -> Pack:
    body = json.loads(text)
    pack = Pack(body["signals"], body["rules"], body.get("disputes", []))
    if wrong := pack.problems():
        raise ValueError("; ".join(wrong))
    return pack


def read_pack(spark: SparkSession, path: str) -> Pack:
    """A pack from a JSON file in any store that Spark reads."""
    text = spark.read.text(path, wholetext=True)
    rows = text.where(F.length("value") <= MOST_BYTES).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path}: one file of at most {MOST_BYTES} characters is a pack")
    return from_json(rows[0][0])


def _starter() -> Pack:
    def terms(name: str) -> list[dict]:
        out = []
        for feature, weight, *rest in P.WEIGHTS[name]:
            term = {"feature": feature, "weight": weight}
            if rest and rest[0] is not None:
                term["cap"] = rest[0]
            if len(rest) > 1:
                term["when"] = [{"feature": f, "at_least": lo, "at_most": hi} for f, lo, hi in rest[1]]
            out.append(term)
        return out

    def clauses(name: str) -> list[list[dict]]:
        return [[{"feature": f, "at_least": lo, "at_most": hi} for f, lo, hi in any_of] for any_of in P.THRESHOLDS[name]]

    rules = [{"rule_id": r, "severity": s, "keywords": list(k), "weights": terms(r), "thresholds": clauses(r)} for r, s, k, *_ in P.RULES]
    disputes = [{"rule_id": r, "keywords": list(k), "weights": terms(r), "thresholds": clauses(r)} for r, k, *_ in P.DISPUTES]
    return Pack({n: list(w) for n, w in P.SIGNALS.items()}, rules, disputes)


STARTER = _starter()
