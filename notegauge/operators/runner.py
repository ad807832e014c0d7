"""Running an external judge: a command that reads a prompt and writes an answer."""

from __future__ import annotations

import shlex
import subprocess
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from notegauge.operators.batching import RetryableError, parse_response
from notegauge.vocab import JUDGMENT_VERSION, PROMPT_VERSION


class RunnerError(Exception):
    """The command cannot be run or failed; trying it again in halves would not help."""


@dataclass(frozen=True)
class CommandRunner:
    """A command line with {output_path} and {vault} in it; the prompt is its input.

    What it writes to the output path is the answer, else what it prints.
    """

    template: str
    vault: str
    timeout: int = 900

    def __call__(self, prompt: str, folder: str) -> str:
        answer = Path(folder) / "answer.txt"
        try:
            command = shlex.split(self.template.format(output_path=answer, vault=self.vault))
        except (KeyError, IndexError, ValueError) as e:
            raise RunnerError(f"invalid command template: {e}") from e
        if not command:
            raise RunnerError("the command is empty")
        try:
            done = subprocess.run(command, input=prompt, text=True, capture_output=True, timeout=self.timeout, cwd=self.vault)
        except subprocess.TimeoutExpired as e:
            raise RetryableError(f"no answer in {self.timeout} seconds") from e
        except OSError as e:
            raise RunnerError(f"the command did not start: {e}") from e
        (Path(folder) / "stdout.txt").write_text(done.stdout, encoding="utf-8")
        (Path(folder) / "stderr.txt").write_text(done.stderr, encoding="utf-8")
        if done.returncode:
            raise RunnerError(f"exit {done.returncode}: {done.stderr[-500:]}")
        return answer.read_text(encoding="utf-8") if answer.exists() else done.stdout


def asker(run: Callable[[str, str], str], prompt_of: Callable[[list[dict]], str], folder: str) -> Callable[[list[dict]], list[dict]]:
    """For batching.collect: a batch's judgments with their provenance stamped; answers that do not parse may be retried."""

    def ask(rows: list[dict]) -> list[dict]:
        try:
            got = parse_response(run(prompt_of(rows), folder))
        except ValueError as e:
            raise RetryableError(str(e)) from e
        return [g | {"schema_version": JUDGMENT_VERSION, "prompt_version": PROMPT_VERSION} for g in got]

    return ask
