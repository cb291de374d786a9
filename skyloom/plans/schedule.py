"""The daily run by the system's scheduler: a line of the user's crontab, or a Windows task.

What is written is built by plain functions; only `act` calls the system.
"""

from __future__ import annotations

import os
import shlex
import subprocess
import sys
from pathlib import Path

NAME = "skyloom-daily"


def command(root: str | Path, python: str = sys.executable, arguments: str = "", windows: bool = False) -> str:
    """The shell command of a daily run in folder root, its output appended to daily_run.log there."""
    quoted = (lambda s: f'"{s}"') if windows else shlex.quote
    log = quoted(str(Path(root) / "daily_run.log"))
    run = " ".join(x for x in (quoted(python), "-m skyloom.cli", "run", arguments.strip()) if x)
    return f"cd {'/d ' if windows else ''}{quoted(str(root))} && {run} >> {log} 2>&1"


def cron_line(time: str, shell_command: str, name: str = NAME) -> str:
    """A crontab line for each day at HH:MM; a percent sign would end a crontab command, so it is escaped."""
    hour, _, minute = time.partition(":")
    if not (hour.isdigit() and minute.isdigit() and int(hour) < 24 and int(minute) < 60):
        raise ValueError(f"not a time of the form HH:MM: {time!r}")
    return f"{int(minute)} {int(hour)} * * * {shell_command.replace('%', chr(92) + '%')} # {name}"


def lines_of(crontab: str, name: str = NAME) -> list[str]:
    return [line for line in crontab.splitlines() if line.endswith(f"# {name}")]


def with_line(crontab: str, line: str | None, name: str = NAME) -> str:
    """The crontab with this line (none: without one) in place of what it had under the name."""
    own = lines_of(crontab, name)
    kept = [x for x in crontab.splitlines() if x not in own]
    return "".join(f"{x}\n" for x in [*kept, *([line] if line else [])])


def task_arguments(action: str, time: str, shell_command: str, name: str = NAME) -> list[str]:
    """Arguments of the Windows scheduler's command for an action."""
    verb, more = {"install": ("/Create", ["/TR", f"cmd /c {shell_command}", "/SC", "DAILY", "/ST", time, "/F"]), "remove": ("/Delete", ["/F"]), "show": ("/Query", [])}[action]
    return ["schtasks", verb, "/TN", name, *more]


def act(action: str, time: str = "07:00", root: str | Path = ".", arguments: str = "", name: str = NAME, run=subprocess.run) -> tuple[int, str]:
    """Installs, removes or shows the daily run: (exit code, what the scheduler says)."""
    root = Path(root).resolve()
    if os.name == "nt":
        done = run(task_arguments(action, time, command(root, arguments=arguments, windows=True), name), capture_output=True, text=True)
        return done.returncode, (done.stdout or done.stderr).strip()
    try:
        crontab = run(["crontab", "-l"], capture_output=True, text=True).stdout or ""
        if action == "show":
            own = lines_of(crontab, name)
            return int(not own), "\n".join(own) or f"{name} isn't scheduled"
        line = cron_line(time, command(root, arguments=arguments), name) if action == "install" else None
        done = run(["crontab", "-"], input=with_line(crontab, line, name), capture_output=True, text=True)
        return done.returncode, done.stderr.strip() or line or f"{name} removed"
    except FileNotFoundError:
        return 1, "there is no crontab here; a line for another scheduler:\n" + cron_line(time, command(root, arguments=arguments), name)
