"""A recipe: resolved steps that replay on any batch or stream, with an exact account of what they did."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, functions as F

from gritsieve.functions.cells import number
from gritsieve.operators.cleaning import is_one_of, tidy
from gritsieve.operators.quantiles import exact_quantiles, most_frequent
from gritsieve.operators.registry import OPERATIONS
from gritsieve.plans.plan import Step
from gritsieve.relations import LEDGER, data_columns, is_text, local_relation


#: Number of the step that drops a row, while the ledger counts.
GONE = "_dropped_by_step"


def _rows_above(df: DataFrame, n: int):
    """How many rows there were before the first `n` went, given how many are left; counted only if none is."""
    return lambda after: after + n if after else df.count()


def _registered(step: Step):
    if step.op not in OPERATIONS:
        raise KeyError(f"Unknown operation {step.op!r}. Registered: {sorted(OPERATIONS)}")
    return OPERATIONS[step.op]


def run_step(df: DataFrame, step: Step) -> DataFrame:
    return _registered(step).run(df, **step.params)


def _number_restored(df: DataFrame, recodes: list[Step]) -> list[bool]:
    """For each recode, whether everything it leaves is a number; one aggregate for all of them."""
    sums = []
    for i, step in enumerate(recodes):
        column, values = step.params["column"], step.params["values"]
        left = F.when(~is_one_of(df, column, values), tidy(df, column))
        sums += [F.count(left).alias(f"kept{i}"), F.count(number(left)).alias(f"numbers{i}")]
    got = df.agg(*sums).first()
    return [got[f"kept{i}"] == got[f"numbers{i}"] for i in range(len(recodes))]


def _filler(df: DataFrame, column: str, method: str):
    value = tidy(df, column)
    if method == "median":
        got = exact_quantiles(df, value, [0.5]).first()
        return got["q"][0] if got else None
    if method == "mean":
        return df.agg(F.avg(value).alias("m")).first()["m"]
    if method == "mode":
        got = most_frequent(df, value).first()
        return got["value"] if got else None
    raise ValueError(f"Unknown fill method: {method}")


def resolve(df: DataFrame, steps: list[Step]) -> list[Step]:
    """Bake in what depends on the data (restored types, fill values), so replay needs no second look."""
    done: list[Step] = []
    i = 0
    while i < len(steps):
        step = steps[i]
        _registered(step)
        if step.op == "recode_sentinel_missing" and "to_number" not in step.params:
            run, seen = [], set()
            while i < len(steps) and steps[i].op == step.op and steps[i].params["column"] not in seen:
                seen.add(steps[i].params["column"])
                run.append(steps[i])
                i += 1
            texts = [s for s in run if is_text(df.schema[s.params["column"]])]
            numeric = dict(zip([s.params["column"] for s in texts], _number_restored(df, texts))) if texts else {}
            fresh = [
                Step(s.op, s.params | {"to_number": numeric.get(s.params["column"], False)}, s.rationale) for s in run
            ]
        else:
            if step.op == "fill_missing" and step.params.get("method", "constant") != "constant" \
                    and step.params.get("value") is None:
                filler = _filler(df, step.params["column"], step.params["method"])
                step = Step(step.op, step.params | {"value": filler}, step.rationale)
            fresh = [step]
            i += 1
        for s in fresh:
            df = run_step(df, s)
        done += fresh
    return done


@dataclass
class Recipe:
    """Resolved steps over a named source."""

    source: str
    steps: list[Step] = field(default_factory=list)

    @classmethod
    def learn(cls, df: DataFrame, steps: list[Step], source: str = "raw") -> Recipe:
        return cls(source, resolve(df, steps))

    def apply(self, df: DataFrame) -> DataFrame:
        """One lazy chain of transformations; nothing runs until an action."""
        for step in self.steps:
            df = run_step(df, step)
        return df

    def row_local(self) -> Recipe:
        """The part that needs no other row, which is what a stream can replay."""
        return Recipe(self.source, [s for s in self.steps if OPERATIONS[s.op].row_local])

    def with_step(self, df: DataFrame, step: Step) -> Recipe:
        """Append a step, resolved against the table as the recipe leaves it."""
        return Recipe(self.source, self.steps + resolve(self.apply(df), [step]))

    def undo(self) -> Recipe:
        """The recipe without its last step; replaying it from the source is the earlier state."""
        return Recipe(self.source, self.steps[:-1])

    def ledger(self, df: DataFrame) -> DataFrame:
        """What every step did: rows, columns and cells touched.

        Rows that a step drops by themselves stay, with the number of the step, and count no further; so all steps up to one
        that compares rows share one aggregate. Where the first rows are dropped, counts follow from those after it. A plan
        with a step for duplicates costs two passes, whatever else it drops. Plain aggregates stay right when tasks are run
        again after a lost executor.
        """
        rows, waiting, compared, state = [], [], None, df

        def settle() -> int:
            got = state.agg(
                F.count(F.lit(1)).alias("rows"),
                *[F.count_if(F.col(GONE) == row["seq"]).alias(f"gone{row['seq']}") for row, marks in waiting if marks is None],
                *[
                    F.coalesce(F.sum(F.col(f"_{what}{row['seq']}").cast("bigint")), F.lit(0)).alias(f"{what}{row['seq']}")
                    for row, marks in waiting for what in marks or ()
                ],
            ).first()
            left = got["rows"]
            if compared:
                row, before = compared
                row["rows_before"], row["rows_after"] = before(left), left
                row["rows_affected"] = row["rows_before"] - left
            for row, marks in waiting:
                row["rows_before"] = left
                if marks is None:
                    left -= got[f"gone{row['seq']}"]
                    row["rows_affected"] = row["rows_before"] - left
                else:
                    row["rows_affected"] = got[f"hit{row['seq']}"] if "hit" in marks else left
                    if "lost" in marks:
                        row["stats"]["became_blank"] = got[f"lost{row['seq']}"]
                row["rows_after"] = left
            return left

        for seq, step in enumerate(self.steps, 1):
            op = _registered(step)
            bare = self._bare(state)
            row = {
                "seq": seq, "op": step.op, "params": json.dumps(step.params, ensure_ascii=False, default=str),
                "rationale": step.rationale, "cols_before": len(data_columns(bare)), "stats": {},
                "recorded_at": datetime.now(UTC).isoformat(timespec="seconds"),
            }
            here = F.col(GONE).isNull() if GONE in state.columns else F.lit(True)
            if op.drops:
                gone = F.when(here & op.drops(bare, **step.params), F.lit(seq))
                state = state.withColumn(GONE, F.coalesce(F.col(GONE), gone) if GONE in state.columns else gone)
                waiting.append((row, None))
            elif step.op == "promote_header_row" and not waiting and not compared:
                compared = (row, _rows_above(bare, step.params.get("drop_rows", 1)))
                state = run_step(bare, step)
            elif op.drops_rows:
                before = settle()
                waiting, compared = [], (row, lambda after, before=before: before)
                state = run_step(self._bare(state.where(here)), step)
            else:
                marks = {
                    what: F.when(here, measure(bare, **step.params))
                    for what, measure in (("hit", op.touched), ("lost", op.lost)) if measure
                }
                state = run_step(state.withColumns({f"_{what}{seq}": m for what, m in marks.items()}), step)
                waiting.append((row, marks))
            row["cols_after"] = len(data_columns(self._bare(state)))
            for key in ("value", "to_number"):
                if key in step.params:
                    row["stats"][{"value": "filled_with", "to_number": "kept_numeric"}[key]] = step.params[key]
            rows.append(row)
        if rows:
            settle()
        for row in rows:
            row["stats"] = json.dumps(row["stats"], default=str)
        return local_relation(df.sparkSession, rows, LEDGER)

    def _bare(self, df: DataFrame) -> DataFrame:
        marks = {f"_{what}{i}" for what in ("hit", "lost") for i in range(1, len(self.steps) + 1)} | {GONE}
        return df.drop(*[c for c in df.columns if c in marks])

    def to_json(self, ledger: DataFrame) -> str:
        """The ledger as one document: `{"source", "entries"}`."""
        entries = [
            r.asDict() | {"params": json.loads(r["params"]), "stats": json.loads(r["stats"])}
            for r in ledger.orderBy("seq").collect()
        ]
        return json.dumps({"source": self.source, "entries": entries}, indent=2, default=str)

    def steps_json(self) -> str:
        return json.dumps({"source": self.source, "steps": [asdict(s) for s in self.steps]}, default=str)

    @classmethod
    def from_json(cls, text: str) -> Recipe:
        """The recipe that `steps_json` wrote, ready to replay in another process."""
        read = json.loads(text)
        steps = [Step(s["op"], s["params"], s["rationale"]) for s in read["steps"]]
        for step in steps:
            _registered(step)
        return cls(read["source"], steps)


def ledger_table(ledger: DataFrame) -> DataFrame:
    """The ledger for reading: number, operation, rows affected, change of shape, reason."""
    shape = F.format_string("%dx%d -> %dx%d", "rows_before", "cols_before", "rows_after", "cols_after")
    why = F.when(F.length("rationale") > 0, F.col("rationale")).otherwise(F.lit("-"))
    return ledger.select("seq", F.col("op").alias("operation"), "rows_affected", shape.alias("shape"), why.alias("why"))
