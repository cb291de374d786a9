from __future__ import annotations

import datetime as dt

import subprocess

import pytest

from skyloom import cli
from skyloom.plans import schedule
from skyloom.plans.store import Store
from skyloom.sources import config

NOW = dt.datetime(2026, 9, 1, 12)


def test_source_commands(tmp_path, capsys):
    file = str(tmp_path / "s.yaml")
    config.save_sources([config.Source("a", "A", "good")], file)
    base = ["--sources", file, "sources"]
    assert cli.main([*base, "add", "--id", "b", "--name", "B", "--url", "bad", "--weight", "0.5"]) == 0
    assert cli.main([*base, "add", "--id", "b", "--name", "B", "--url", "bad"]) == 2
    assert cli.main([*base, "disable", "b"]) == 0 and cli.main([*base, "enable", "zz"]) == 2
    assert cli.main([*base, "list", "--enabled"]) == 0
    assert capsys.readouterr().out.count("w=") == 1
    assert [(s.id, s.enabled, s.weight) for s in config.load_sources(file)] == [("a", True, 1.0), ("b", False, 0.5)]


def test_fetch_check_stats_feedback(spark, tmp_path, capsys):
    def payload(url, timeout=20, retries=2):
        if url == "bad":
            raise OSError("no route")
        return b"<rss><channel><item><title>US and China talks</title><link>https://a.com/1</link></item></channel></rss>"

    file, store = str(tmp_path / "s.yaml"), str(tmp_path / "db")
    config.save_sources([config.Source("a", "A", "good"), config.Source("b", "B", "bad")], file)
    base = ["--sources", file, "--store", store]
    run = lambda *args: cli.main([*base, *args], spark, NOW, payload)
    assert run("fetch") == 0 and "fetched=1 new=1 source_errors=1" in capsys.readouterr().out
    assert run("fetch") == 0 and "fetched=1 new=0" in capsys.readouterr().out
    assert run("sources", "check") == 1 and "failures=1" in capsys.readouterr().out
    health = {r["id"]: r["health"] for r in Store(spark, store).sources().collect()}
    assert health["a"] == '{"ok":true,"items":1}' and "no route" in health["b"]
    assert run("feedback", "add", "--kind", "event_relation", "--target", "5", "--rating", "confirm") == 1
    assert run("feedback", "add", "--kind", "source", "--target", "5", "--rating", "good", "--note", "n") == 0
    assert run("feedback", "list", "--kind", "source") == 0 and "note=n\ntotal=1" in capsys.readouterr().out
    assert run("stats") == 0 and "articles: 1" in capsys.readouterr().out


def test_schedule_lines():
    shell = schedule.command("/data/my news", "/usr/bin/python3", "--hours 48")
    assert shell == "cd '/data/my news' && /usr/bin/python3 -m skyloom.cli run --hours 48 >> '/data/my news/daily_run.log' 2>&1"
    line = schedule.cron_line("07:05", shell)
    assert line.startswith("5 7 * * * cd ") and line.endswith("# skyloom-daily")
    assert "\\%" in schedule.cron_line("07:05", "date +%F")
    with pytest.raises(ValueError):
        schedule.cron_line("25:00", shell)
    other = "0 1 * * * backup\n"
    once = schedule.with_line(other, line)
    assert schedule.with_line(once, schedule.cron_line("08:00", shell)).count("skyloom.cli") == 1
    assert schedule.with_line(once, None) == other and schedule.lines_of(once) == [line]
    made = schedule.task_arguments("install", "07:00", schedule.command("D:/w", "py", windows=True), "daily")
    assert made[:4] == ["schtasks", "/Create", "/TN", "daily"] and made[made.index("/ST") + 1] == "07:00" and '"D:/w"' in made[made.index("/TR") + 1]
    assert schedule.task_arguments("remove", "", "")[1] == "/Delete" and schedule.task_arguments("show", "", "")[1] == "/Query"


def test_schedule_by_crontab():
    table = ["0 1 * * * backup\n"]

    def run(args, input=None, **_):
        if args[1] == "-":
            table[0] = input
        return subprocess.CompletedProcess(args, 0, table[0], "")

    assert schedule.act("show", run=run)[0] == 1
    assert schedule.act("install", "06:30", "/tmp", run=run)[0] == 0 and "30 6 * * *" in table[0] and "backup" in table[0]
    assert schedule.act("show", run=run) == (0, schedule.lines_of(table[0])[0])
    assert schedule.act("remove", run=run)[0] == 0 and table[0] == "0 1 * * * backup\n"

    def none(*_, **__):
        raise FileNotFoundError

    assert schedule.act("install", run=none)[0] == 1


def test_backend_command(capsys):
    class Model:
        name, model = "m", "x"

        def complete(self, prompt, context):
            return {"results": [{"id": 1, "relevant": True}, {"id": 2}]}

    assert cli.check_backend(None) == 0 and cli.check_backend(Model()) == 0
    assert "#1 relevant=True" in capsys.readouterr().out
    Model.complete = lambda self, prompt, context: {}
    assert cli.check_backend(Model()) == 1
