"""``python -m claimlake``: shards from the command line."""

from __future__ import annotations

import argparse
import json
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from claimlake import registry
from claimlake.plans.gate import NotReadOnly
from claimlake.session import Session, answer_of
from claimlake.sources import documents, shards


def _spark() -> SparkSession:
    spark = SparkSession.builder.appName("claimlake").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shell(session: Session, lines) -> None:
    """Runs each line as a query and shows its first 20 rows."""
    for line in lines:
        if line.strip().lower() in ("exit", "quit"):
            break
        if line.strip():
            try:
                session.sql(line).show(20, truncate=80)
            except (NotReadOnly, Exception) as error:  # a wrong query ends no session
                print(f"{type(error).__name__}: {str(error).splitlines()[0]}")


def handler(session: Session, token: str | None = None) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self, code: int, body: object) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            self.wfile.write(data)

        def _route(self, body: dict) -> None:
            if token and self.headers.get("Authorization") != f"Bearer {token}":
                return self._answer(401, {"error": "token"})
            try:
                if self.path in ("/", "/health"):
                    return self._answer(200, session.health())
                if self.path == "/catalog":
                    return self._answer(200, session.catalog_json())
                if self.path == "/query":
                    return self._answer(200, session.query_json(body["sql"]))
                if self.path == "/chat":
                    df = session.ask(body["question"])
                    return self._answer(200, answer_of(df))
                if self.path == "/mount":
                    return self._answer(200, {"mount_id": session.mount(body["path"]).mount_id})
                if self.path.startswith("/unmount/"):
                    session.unmount(self.path.rsplit("/", 1)[1])
                    return self._answer(200, {"ok": True})
            except (ValueError, KeyError) as error:
                return self._answer(400, {"error": str(error)})
            return self._answer(404, {"error": "no such path"})

        def do_GET(self) -> None:
            self._route({})

        def do_POST(self) -> None:
            self._route(json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}"))

        def log_message(self, *args: object) -> None:
            pass

    return Handler


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("claimlake")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("list", "verify", "extract", "plan", "mount", "ask", "query", "serve"):
        sub = commands.add_parser(name)
        sub.add_argument("path")
        if name in ("ask", "query"):
            sub.add_argument("text")
        if name == "serve":
            sub.add_argument("--port", type=int, default=8080)
            sub.add_argument("--token")
    commands.add_parser("plugins")
    o = parser.parse_args(args)
    if o.command == "plugins":
        good, bad = registry.plugins()
        print(json.dumps({"loaded": sorted(good), "failed": bad}))
        return 0
    spark = _spark()
    if o.command == "list":
        shards.store_listing(spark, o.path).show(truncate=False)
    elif o.command == "verify":
        try:
            shards.verify(spark, o.path)
        except shards.ShardError as error:
            print(error)
            return 1
        print("verified")
    elif o.command == "plan":
        print(documents.plan_job(documents.files(spark, o.path)).first().asDict())
    elif o.command == "extract":
        docs = documents.ingest(documents.files(spark, o.path, (".txt", ".md")))
        registry.run(docs, list(registry.GENERATORS)).show(50, truncate=60)
    else:
        session = Session(spark)
        session.mount(o.path)
        if o.command == "mount":
            shell(session, sys.stdin)
        elif o.command == "ask":
            session.ask(o.text).show(50, truncate=80)
        elif o.command == "query":
            print(json.dumps(session.query_json(o.text), default=str))
        else:
            ThreadingHTTPServer(("127.0.0.1", o.port), handler(session, o.token)).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
