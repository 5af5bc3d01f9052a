"""A small task runner: dependencies, trigger rules, retries, branches, callbacks."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

RULES = ("all_success", "one_success", "one_failed", "all_done")


@dataclass
class Task:
    name: str
    run: Callable[[dict[str, Any]], Any]
    after: Sequence[str] = ()
    rule: str = "all_success"
    retries: int = 2
    backoff_s: float = 1.0
    timeout_s: float | None = None
    branch: bool = False  # its result names the tasks that go on


@dataclass
class Outcome:
    state: str  # success, failed or skipped
    value: Any = None
    error: str = ""
    attempts: int = 0
    seconds: float = 0.0


@dataclass
class Pipeline:
    """Tasks run in dependency order; each gets the values of those before it by name."""

    name: str
    tasks: list[Task] = field(default_factory=list)
    on_failure: Callable[[str, Outcome], None] | None = None
    on_success: Callable[[str, Outcome], None] | None = None
    sla_s: float | None = None
    on_sla_miss: Callable[[str, float], None] | None = None
    sleep: Callable[[float], None] = time.sleep
    begin: Callable[[str], Any] | None = None  # called in the thread of a task with a time-out
    cancel: Callable[[str], Any] | None = None  # ends the work of a task that timed out
    grace_s: float = 60.0

    def add(self, *args, **kwargs) -> Pipeline:
        self.tasks.append(Task(*args, **kwargs))
        return self

    def _order(self) -> list[Task]:
        by, done, out = {t.name: t for t in self.tasks}, set(), []

        def visit(t: Task, path: tuple[str, ...]) -> None:
            if t.name in path:
                raise ValueError(f"tasks wait for each other: {path}")
            if t.name not in done:
                for a in t.after:
                    visit(by[a], (*path, t.name))
                done.add(t.name)
                out.append(t)

        for t in self.tasks:
            visit(t, ())
        return out

    def run(self, params: dict[str, Any] | None = None) -> dict[str, Outcome]:
        began, results, cut = time.monotonic(), {}, set()
        for task in self._order():
            states = [results[a].state for a in task.after]
            go = {
                "all_success": all(s == "success" for s in states),
                "one_success": not states or "success" in states,
                "one_failed": "failed" in states,
                "all_done": True,
            }[task.rule]
            if not go or (task.name in cut and task.rule == "all_success"):
                results[task.name] = Outcome("skipped")
                continue
            out = self._attempt(task, {"params": params or {}, **{k: v.value for k, v in results.items()}})
            results[task.name] = out
            if task.branch and out.state == "success":
                chosen = {out.value} if isinstance(out.value, str) else set(out.value or ())
                cut |= {t.name for t in self.tasks if task.name in t.after and t.name not in chosen}
            hook = self.on_success if out.state == "success" else self.on_failure
            if hook:
                hook(task.name, out)
        took = time.monotonic() - began
        if self.sla_s is not None and took > self.sla_s and self.on_sla_miss:
            self.on_sla_miss(self.name, took)
        return results

    def _attempt(self, task: Task, values: dict[str, Any]) -> Outcome:
        began, error = time.monotonic(), ""
        for attempt in range(1, task.retries + 2):
            value, failure, ended = self._call(task, values)
            if failure is None:
                return Outcome("success", value, "", attempt, time.monotonic() - began)
            error = f"{type(failure).__name__}: {failure}"
            if not ended or attempt > task.retries:  # two attempts never run at once
                break
            self.sleep(task.backoff_s * 2 ** (attempt - 1))
        return Outcome("failed", None, error, attempt, time.monotonic() - began)

    def _call(self, task: Task, values: dict[str, Any]) -> tuple[Any, Exception | None, bool]:
        """The task's value or failure, and whether its work has ended."""
        box: dict[str, Any] = {}

        def work():
            try:
                if self.begin and task.timeout_s is not None:
                    self.begin(task.name)
                box["value"] = task.run(values)
            except Exception as e:  # noqa: BLE001
                box["failure"] = e

        if task.timeout_s is None:
            work()
            return box.get("value"), box.get("failure"), True
        thread = threading.Thread(target=work, name=task.name, daemon=True)
        thread.start()
        thread.join(task.timeout_s)
        if not thread.is_alive():
            return box.get("value"), box.get("failure"), True
        if self.cancel:
            self.cancel(task.name)
            thread.join(self.grace_s)
        return None, TimeoutError(f"{task.name} took over {task.timeout_s} s"), not thread.is_alive()
