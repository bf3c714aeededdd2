"""Providers, whole tasks and the command line, over files of their own."""

import json
import os

import pytest

from corpusloom import cli
from corpusloom.plans import tasks
from corpusloom.sources import files, glossary, providers

ASKED = [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]


def recorded(seen, *replies):
    def transport(url, headers, payload, streamed):
        seen.append((url, headers, payload, streamed))
        yield from replies

    return transport


@pytest.mark.parametrize(
    ("kind", "reply", "usage", "stop"),
    [
        (providers.Claude, {"content": [{"type": "other"}, {"type": "text", "text": "T"}], "model": "m2", "usage": {"input_tokens": 3, "output_tokens": 4}, "stop_reason": "end"}, (3, 4, 7), "end"),
        (providers.Gemini, {"candidates": [{"content": {"parts": [{"text": "T"}]}, "finishReason": "STOP"}], "usageMetadata": {"promptTokenCount": 3, "totalTokenCount": 9}}, (3, 0, 9), "STOP"),
        (providers.Ollama, {"choices": [{"message": {"content": "T"}}], "model": "m2"}, (0, 0, 0), "unknown"),
    ],
)
def test_answers_of_services(kind, reply, usage, stop):
    seen = []
    got = kind({"api_key": "k", "model": "own"}, recorded(seen, reply)).chat(ASKED, {"model": ""})
    assert (got["content"], tuple(got["usage"].values()), got["finish_reason"]) == ("T", usage, stop)
    url, headers, payload, streamed = seen[0]
    assert not streamed and ("own" in url or payload["model"] == "own")
    if kind is providers.Claude:
        assert payload["max_tokens"] == 4096 and payload["system"] == "s" and [m["role"] for m in payload["messages"]] == ["user", "assistant"] and headers["x-api-key"] == "k"
    if kind is providers.Gemini:
        assert [c["role"] for c in payload["contents"]] == ["user", "model"] and payload["systemInstruction"]["parts"][0]["text"] == "s" and "generationConfig" not in payload
    if kind is providers.Ollama:
        assert [m["role"] for m in payload["messages"]] == ["system", "user", "assistant"] and "max_tokens" not in payload


@pytest.mark.parametrize(
    ("kind", "events"),
    [
        (providers.Claude, [{"type": "message_start"}, *({"type": "content_block_delta", "delta": {"type": "text_delta", "text": t}} for t in "ab")]),
        (providers.Gemini, [{"candidates": [{"content": {"parts": [{"text": t}]}}]} for t in ("a", "", "b")]),
        (providers.Ollama, [{"choices": [{"delta": {"content": t}}]} for t in ("a", None, "b")]),
    ],
)
def test_streams_of_services(kind, events):
    seen, parts, ends = [], [], []
    made = kind({"api_key": "k", "model": "m"}, recorded(seen, *events))
    assert list(made.stream(ASKED, {}))[-1] == {"content": "", "done": True}
    assert providers.stream_response(made, ASKED, {"temperature": 0.5, "max_tokens": 7}, parts.append, lambda: ends.append(1)) == "ab"
    assert parts == ["a", "b"] and ends == [1] and seen[1][3]
    assert "0.5" in json.dumps(seen[1][2]) and "7" in json.dumps(seen[1][2])


def test_keys_and_names(monkeypatch):
    monkeypatch.delenv("ANTHROPIC_API_KEY", raising=False)
    monkeypatch.setenv("GOOGLE_API_KEY", "g")
    with pytest.raises(ValueError, match="ANTHROPIC_API_KEY"):
        providers.create_provider("claude", "m")
    assert providers.with_key("gemini", {"model": "m"}) == {"model": "m", "api_key": "g"} and providers.with_key("echo", {}) == {}
    assert isinstance(providers.create_provider("ollama", "m"), providers.Ollama)
    with pytest.raises(ValueError, match="Unsupported provider"):
        providers.create_provider("none", "m")


def test_event_stream_over_http():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Serves(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["content-length"])))
            self.send_response(200)
            self.end_headers()
            if asked.get("stream"):
                self.wfile.write(b': note\n\ndata: {"choices": [{"delta": {"content": "x"}}]}\n\ndata: [DONE]\n\n')
            else:
                self.wfile.write(json.dumps({"choices": [{"message": {"content": asked["model"]}}]}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Serves)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    made = providers.create_provider("ollama", "mm", base_url=f"http://127.0.0.1:{server.server_port}")
    assert made.chat(ASKED, {})["content"] == "mm" and providers.stream_response(made, ASKED) == "x"
    server.shutdown()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "docs" / "b").mkdir(parents=True)
    for name, text in (("a.md", "one `x`"), ("b/c.md", "---\nt: 1\n---\ntwo"), ("b/d.md", "  \n"), ("b/e.txt", "no")):
        (tmp_path / "docs" / name).write_text(text)
    return tmp_path


def test_batch_writes_and_counts(spark, folder):
    steps = []
    got = {r["path"]: r for r in tasks.batch(spark, str(folder), "docs/**/*.md", "ja", output_dir="out", on_progress=steps.append).collect()}
    assert {p: (r["output_path"], r["error"], r["current"], r["total"]) for p, r in got.items()} == {
        "docs/a.md": ("out/a.md", None, 1, 3), "docs/b/c.md": ("out/b/c.md", None, 2, 3), "docs/b/d.md": ("out/b/d.md", "Input is empty", 3, 3),
    }
    assert steps[-1] == {"total": 3, "current": 3, "succeeded": 2, "failed": 1, "skipped": 0} and [s["current"] for s in steps] == [1, 2, 3]
    assert (folder / "out/a.md").read_text() == "one `x`" and (folder / "out/b/c.md").read_text() == "---\nt: 1\n---\ntwo" and not (folder / "out/b/d.md").exists()
    beside = tasks.batch(spark, str(folder), "docs/*.md", "ja")
    assert tasks.totals(beside).first()["succeeded"] == 1 and (folder / "docs/a.ja.md").exists()


def test_dry_batch_calls_nothing(spark, folder):
    rows = tasks.batch(spark, str(folder), "docs/**/*.md", "ja", provider="no such provider", output_dir="out", dry_run=True)
    assert tasks.totals(rows).first()["succeeded"] == 3 and not (folder / "out").exists()
    with pytest.raises(files.AppError, match="No files matched"):
        tasks.batch(spark, str(folder), "docs/*.rst", "ja")


def test_numbers_run_through(spark):
    rows = spark.range(5000).selectExpr("format_string('%08d', (id * 7919) % 5000) as path")
    got = tasks.numbered(rows).orderBy("path").collect()
    assert [r["current"] for r in got] == list(range(1, 5001)) and {r["total"] for r in got} == {5000}
    assert tasks.numbered(rows.limit(0)).count() == 0


def test_command_line(spark, folder, capsys, monkeypatch):
    monkeypatch.chdir(folder)
    words = "version: 1\nlanguages: [en, ja]\nterms:\n- {canonical: api, type: noun, translations: {en: api, ja: ''}, do_not_use: {en: [interfaze]}}\n"
    (folder / "g.yaml").write_text(words)
    (folder / "bad.md").write_text("ok\nan interfaze\n")
    (folder / "bad.json").write_text('{"k": ["an interfaze"]}')
    (folder / "odd*[x].md").write_text("fine\n")
    run = lambda *a: cli.main(a, spark)
    assert run("glossary", "check", "--input", "bad.md", "--glossary", "g.yaml", "--lang", "en") == 1
    assert 'Line 2: "interfaze" → use "api"' in capsys.readouterr().out
    assert run("glossary", "check", "--input", "bad.json", "--glossary", "g.yaml", "--lang", "en") == 1 and "k[0]" in capsys.readouterr().out
    assert run("glossary", "check", "--input", "odd*[x].md", "--glossary", "g.yaml", "--lang", "en") == 0
    assert run("glossary", "check", "--input", "docs/a.md", "--glossary", "g.yaml", "--lang", "fr") == 1 and "Available: en, ja" in capsys.readouterr().err
    assert run("glossary", "check", "--input", "none.md", "--glossary", "g.yaml", "--lang", "en") == 1 and "Input file not found" in capsys.readouterr().err
    assert run("glossary", "check", "--input", "bad.md", "--glossary", "none.yaml", "--lang", "en") == 1
    assert run("glossary", "review", "--glossary", "g.yaml", "--output", "r.md") == 0 and "# Glossary Review Report" in (folder / "r.md").read_text()
    capsys.readouterr()
    (folder / "s.yaml").write_text(words.replace("ja: ''", "de: x"))
    assert run("glossary", "sync", "--glossary", "s.yaml") == 0 and "api lacks ja" in capsys.readouterr().out
    assert glossary.load_glossary("s.yaml").terms[0]["translations"]["ja"] == ""
    assert run("glossary", "init", "--output", "s.yaml") == 1 and run("glossary", "init", "--output", "s.yaml", "--force") == 0
    assert run("init") == 0 and run("init") == 1 and run("init", "--force") == 0 and files.load_config(cli.CONFIG).provider == "claude"


def test_translate_from_the_command_line(spark, folder, capsys, monkeypatch):
    monkeypatch.chdir(folder)
    monkeypatch.setitem(providers._FACTORIES, "ollama", lambda options: providers.Echo())
    (folder / cli.CONFIG).write_text("provider: ollama\nmodel: m\n")
    assert cli.main(["translate", "--input", "docs/a.md", "--lang", "ja"], spark) == 0 and (folder / "docs/a.ja.md").read_text() == "one `x`"
    assert cli.main(["--dry-run", "translate", "--input", "docs/b/c.md", "--lang", "ja"], spark) == 0 and not os.path.exists("docs/b/c.ja.md")
    assert cli.main(["translate", "--input", "docs/b/d.md", "--lang", "ja"], spark) == 1
    capsys.readouterr()
    assert cli.main(["--verbose", "translate", "--input", "docs/b/*.md", "--lang", "ja", "--output-dir", "out"], spark) == 0
    said = capsys.readouterr()
    assert "[1/2] docs/b/c.md became out/c.md" in said.out and "Total 2, succeeded 1, failed 1" in said.out and "[2/2] docs/b/d.md failed" in said.err
    assert cli.main(["translate", "--input", "none/*.md", "--lang", "ja"], spark) == 1 and cli.main(["--config", "none.yaml", "translate", "--input", "docs/a.md", "--lang", "ja"], spark) == 1
