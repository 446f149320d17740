"""A cleaning history over immutable frames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from plumbline.operators import clean, quality
from plumbline.session import cut_lineage

# Plans deeper than this many steps are written out once.
STEPS_PER_CHECKPOINT = 10


@dataclass
class Workbench:
    """Holds the frames of all steps; each frame's plan is its snapshot."""

    original: DataFrame
    row_key: str | None = None
    frames: list[DataFrame] = field(default_factory=list)
    steps: list[dict] = field(default_factory=list)

    @property
    def current(self) -> DataFrame:
        return self.frames[-1] if self.frames else self.original

    def preview(self, operations: list[dict]) -> dict:
        return clean.preview(self.current, operations, self.row_key)

    def apply(self, operations: list[dict]) -> dict:
        before = self.current
        after, records = clean.apply_operations(before, operations, self.row_key)
        if (len(self.frames) + 1) % STEPS_PER_CHECKPOINT == 0:
            after = cut_lineage(after)
        self.frames.append(after)
        step = {"operations": operations, "records": records, "columns_before": len(before.columns),
                "columns_after": len(after.columns)}
        self.steps.append(step)
        return step

    def undo(self) -> bool:
        """Go back one step; ``False`` if there is none."""
        if not self.frames:
            return False
        self.frames.pop()
        self.steps.pop()
        return True

    def reset(self) -> None:
        self.frames.clear()
        self.steps.clear()

    def summary(self) -> dict:
        ignore = (self.row_key,) if self.row_key else ()
        return {
            "original": clean.frame_stats(self.original, ignore),
            "current": clean.frame_stats(self.current, ignore),
            "steps": list(self.steps),
        }

    def _bare(self, df: DataFrame) -> DataFrame:
        return df.drop(self.row_key) if self.row_key else df

    def score_change(self) -> DataFrame:
        """``(stage, overall, grade, issues)`` before the first and after the last step."""
        parts = []
        for stage, frame in (("before", self.original), ("after", self.current)):
            scored = quality.overall_score(quality.analyze_quality(self._bare(frame)))
            parts.append(scored.selectExpr(f"'{stage}' as stage", "*"))
        return parts[0].unionByName(parts[1])
