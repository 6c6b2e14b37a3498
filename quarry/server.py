"""A threaded TCP front: statements and JSON answers, each behind a four-byte length."""

from __future__ import annotations

import http.server
import json
import socket
import socketserver
import struct

from quarry.engine import Engine


def send(sock: socket.socket, text: str) -> None:
    data = text.encode()
    sock.sendall(struct.pack(">I", len(data)) + data)


def receive(sock: socket.socket) -> str | None:
    head = _exactly(sock, 4)
    body = _exactly(sock, struct.unpack(">I", head)[0]) if head else None
    return None if body is None else body.decode()


def _exactly(sock: socket.socket, n: int) -> bytes | None:
    out = b""
    while len(out) < n:
        part = sock.recv(n - len(out))
        if not part:
            return None
        out += part
    return out


def answer(engine: Engine, sql: str, most: int = 10_000) -> str:
    """The JSON answer to a statement: status, rows (at most ``most``, and whether there are more), message, error."""
    result = engine.run(sql)
    if result.error is not None:
        return json.dumps({"status": "error", "error": result.error})
    if result.df is None:
        return json.dumps({"status": "ok", "message": result.message})
    rows = [json.loads(r) for r in result.df.toJSON().take(most + 1)]
    return json.dumps({"status": "ok", "rows": rows[:most], "more": len(rows) > most})


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 54321) -> socketserver.ThreadingTCPServer:
    """A server that is bound and not yet running; serve_forever() runs it."""

    class Handler(socketserver.BaseRequestHandler):
        def handle(self) -> None:
            while (sql := receive(self.request)) is not None:
                send(self.request, answer(engine, sql))

    socketserver.ThreadingTCPServer.allow_reuse_address = True
    return socketserver.ThreadingTCPServer((host, port), Handler)


def serve_http(engine: Engine, host: str = "127.0.0.1", port: int = 54322) -> http.server.ThreadingHTTPServer:
    """The same answers to statements that POST requests bring; bound and not yet running."""

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            sql = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
            body = answer(engine, sql).encode()
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args) -> None:
            pass

    return http.server.ThreadingHTTPServer((host, port), Handler)


class Client:
    def __init__(self, host: str = "127.0.0.1", port: int = 54321):
        self.address = (host, port)

    def query(self, sql: str) -> dict:
        with socket.create_connection(self.address) as sock:
            send(sock, sql)
            return json.loads(receive(sock) or "{}")
