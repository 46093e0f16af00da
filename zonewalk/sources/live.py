"""Ports to the outside: DNS over UDP and registration lookups. Both are off unless called; a recorded table stands in."""

from __future__ import annotations

import random
import socket
import struct
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewalk.functions import names
from zonewalk.operators.analysis import UNREGISTERED
from zonewalk.plans.storage import stored
from zonewalk.sources.readers import RESPONSES, TIMED

TIMEOUT_S, TRIES = 2.0, 3
#: Questions that a task has open at a time, and questions of a task, about: a silent server holds up no other.
AT_ONCE, PER_TASK = 64, 2000
#: Record type codes.
TYPES = {"NS": 2, "A": 1, "AAAA": 28}
NAMES = {code: name for name, code in TYPES.items()}
#: Opens a datagram socket; a proxy is another such function.
Open = Callable[[], socket.socket]


def _direct() -> socket.socket:
    return socket.socket(socket.AF_INET, socket.SOCK_DGRAM)


class Relayed:
    """A way to the network through a SOCKS version 5 proxy, used as a datagram socket that is connected to one server.

    `stream` opens a stream to a server through the same proxy, so nothing goes past it. Pass `relay(...)` as an Open.
    """

    def __init__(self, host: str, port: int, user: str | None = None, password: str = "") -> None:
        self.host, self.port, self.user, self.password = host, port, user, password
        self.link, self.control, self.target = _direct(), None, b""

    def __enter__(self) -> Relayed:
        return self

    def __exit__(self, *_: object) -> None:
        self.link.close()
        if self.control:
            self.control.close()

    def settimeout(self, seconds: float) -> None:
        self.link.settimeout(seconds)

    def _asked(self, command: int, target: bytes) -> tuple[socket.socket, tuple[str, int]]:
        """A connection to the proxy on which `command` was granted, and the address that it gave."""
        control = socket.create_connection((self.host, self.port), timeout=TIMEOUT_S)
        try:
            method = 2 if self.user else 0
            control.sendall(bytes([5, 1, method]))
            if _exactly(control, 2) != bytes([5, method]):
                raise OSError("proxy takes no such login")
            if self.user:
                user, word = self.user.encode(), self.password.encode()
                control.sendall(bytes([1, len(user)]) + user + bytes([len(word)]) + word)
                if _exactly(control, 2)[1]:
                    raise OSError("proxy refuses the login")
            control.sendall(bytes([5, command, 0]) + target)
            granted = _exactly(control, 4)
            if granted[1]:
                raise OSError(f"proxy says {granted[1]}")
            size = {1: 4, 4: 16}.get(granted[3]) or _exactly(control, 1)[0]
            where, port = _exactly(control, size), struct.unpack(">H", _exactly(control, 2))[0]
        except BaseException:
            control.close()
            raise
        name = where.decode() if granted[3] == 3 else socket.inet_ntop(socket.AF_INET if size == 4 else socket.AF_INET6, where)
        return control, (name, port)

    def connect(self, server: tuple[str, int]) -> None:
        self.target = _socks_address(*server)
        self.control, (host, port) = self._asked(3, _socks_address("0.0.0.0", 0))
        host = self.host if host in ("0.0.0.0", "::") else host
        family, _, _, _, relay = socket.getaddrinfo(host, port, type=socket.SOCK_DGRAM)[0]
        if family != self.link.family:
            seconds = self.link.gettimeout()
            self.link.close()
            self.link = socket.socket(family, socket.SOCK_DGRAM)
            self.link.settimeout(seconds)
        self.link.connect(relay)

    def send(self, message: bytes) -> None:
        self.link.send(bytes(3) + self.target + message)

    def recv(self, size: int) -> bytes:
        """The next datagram of the server; those in pieces or of others are passed over."""
        head = bytes(3) + self.target
        while not (data := self.link.recv(size + len(head))).startswith(head):
            pass
        return data[len(head) :]

    def stream(self, server: str, port: int) -> socket.socket:
        return self._asked(1, _socks_address(server, port))[0]


def _socks_address(server: str, port: int) -> bytes:
    kind, family = (4, socket.AF_INET6) if ":" in server else (1, socket.AF_INET)
    return bytes([kind]) + socket.inet_pton(family, server) + struct.pack(">H", port)


def _exactly(link: socket.socket, size: int) -> bytes:
    data = b""
    while len(data) < size:
        part = link.recv(size - len(data))
        if not part:
            raise OSError("proxy hung up")
        data += part
    return data


def relay(host: str, port: int, user: str | None = None, password: str = "") -> Open:
    """An Open that goes through the SOCKS version 5 proxy at `host`."""
    return partial(Relayed, host, port, user, password)


def question(domain: str, kind: str, number: int) -> bytes:
    """A query message without recursion."""
    name = b"".join(bytes([len(x)]) + x for x in domain.rstrip(".").encode("idna").split(b".") if x)
    return struct.pack(">6H", number, 0, 1, 0, 0, 0) + name + b"\0" + struct.pack(">2H", TYPES[kind], 1)


def _name(data: bytes, at: int) -> tuple[str, int]:
    parts, end, hops = [], None, 0
    while data[at]:
        if data[at] >= 0xC0:
            end = end or at + 2
            at, hops = struct.unpack(">H", data[at : at + 2])[0] & 0x3FFF, hops + 1
            if hops > 64:
                raise ValueError("compressed name loops")
            continue
        parts.append(data[at + 1 : at + 1 + data[at]].decode("latin-1"))
        at += 1 + data[at]
    return ".".join(parts) + ".", end or at + 1


def answer(data: bytes) -> tuple[int, list[str]]:
    """The code of a response and its NS, A and AAAA records as text: answers, then additional, then authority."""
    _, flags, questions, *counts = struct.unpack(">6H", data[:12])
    at, sections = 12, []
    for _ in range(questions):
        at = _name(data, at)[1] + 4
    for n in counts:
        rows = []
        for _ in range(n):
            owner, at = _name(data, at)
            kind, _, ttl, size = struct.unpack(">2HIH", data[at : at + 10])
            at += 10
            if kind in NAMES:
                value = _name(data, at)[0] if kind == 2 else socket.inet_ntop(socket.AF_INET if kind == 1 else socket.AF_INET6, data[at : at + size])
                rows.append(f"{owner} {ttl} IN {NAMES[kind]} {value}")
            at += size
        sections.append(rows)
    return flags & 15, sections[0] + sections[2] + sections[1]


def _stream(server: str, port: int) -> socket.socket:
    return socket.create_connection((server, port), timeout=TIMEOUT_S)


def _whole(message: bytes, server: str, port: int, stream: Callable[[str, int], socket.socket]) -> bytes:
    """The reply over a stream, where the datagram was cut off."""
    with stream(server, port) as link, link.makefile("rb") as reply:
        link.sendall(struct.pack(">H", len(message)) + message)
        size = struct.unpack(">H", reply.read(2))[0]
        data = reply.read(size)
    if len(data) < size or data[:2] != message[:2]:
        raise ValueError("reply is cut off or to another question")
    return data


def exchange(message: bytes, server: str, opens: list[Open], port: int = 53) -> bytes:
    """The reply of `server` to `message`; datagrams with another number are not it and are passed over."""
    with random.choice(opens)() as link:
        link.settimeout(TIMEOUT_S)
        link.connect((server, port))
        link.send(message)
        while True:
            data = link.recv(65535)
            if len(data) >= 12 and data[:2] == message[:2] and data[2] & 0x80:
                break
        stream = getattr(link, "stream", _stream)
    return _whole(message, server, port, stream) if data[2] & 2 else data


def ask(domain: str, server: str, opens: list[Open], port: int = 53) -> list[tuple]:
    """Rows of readers.RESPONSES for one name and server: three questions, all begun again after a failure, TRIES times in all.

    Codes are those of the questions that were answered in the last try.
    """
    for attempt in range(TRIES):
        lines, codes = [], []
        try:
            for kind in TYPES:
                code, rows = answer(exchange(question(domain, kind, random.randrange(65536)), server, opens, port))
                codes.append(code)
                lines += rows
            return [(domain, server, *codes, False, i, x) for i, x in enumerate(lines)] or [(domain, server, *codes, False, 0, None)]
        except (OSError, ValueError, IndexError, struct.error):
            if attempt == TRIES - 1:
                return [(domain, server, *codes, *[None] * (len(TYPES) - len(codes)), True, 0, None)]
    return []


def timed_ask(domain: str, server: str, opens: list[Open] | None = None, port: int = 53) -> list[tuple]:
    """Rows of readers.TIMED: those of `ask`, with the seconds that they took."""
    begun = time.monotonic()
    rows = ask(domain, server, opens or [_direct], port)
    took = time.monotonic() - begun
    return [(*r, took) for r in rows]


def fetch(questions: DataFrame, opens: list[Open] | None = None, timed: bool = False) -> DataFrame:
    """Live answers to distinct questions (domain, nameserver), as readers.RESPONSES, or readers.TIMED if `timed`. `opens`: ways to the network, one drawn per message.

    Questions are spread over tasks by their number, and a task has many open at a time.
    """

    schema = TIMED if timed else RESPONSES
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for frame in frames:
                rows = [r for got in pool.map(lambda q: timed_ask(*q, opens), zip(frame.domain, frame.nameserver)) for r in got]
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in TIMED.split(", ")])
                yield out.astype({c: "Int32" for c in ("rcode", "rcode_a", "rcode_aaaa", "seq")})[columns]

    asked = stored(questions.select("domain", "nameserver").distinct(), "questions")
    tasks = max(asked.sparkSession.sparkContext.defaultParallelism, -(-asked.count() // PER_TASK))
    return asked.repartition(tasks, "domain", "nameserver").mapInPandas(run, schema)


#: Rows of registration look-ups. status: answered, silent (nothing was said), timeout, refused, failed, or no server.
LOOKUPS = "domain string, server string, status string, tries int, text string"
#: Questions a second that a registry's server is sent, and servers that one look-up is sent on to, at most.
RATE, HOPS = 5.0, 3


def said(domain: str, server: str, port: int = 43, timeout: float = TIMEOUT_S) -> str:
    """What a registration server says of `domain`, all of it within `timeout` seconds of the first word sent."""
    asked = domain.rstrip(".").encode("idna") + b"\r\n"
    with socket.create_connection((server, port), timeout=timeout) as link:
        link.sendall(asked)
        until, parts = time.monotonic() + timeout, []
        while part := link.recv(65536):
            parts.append(part)
            link.settimeout(max(until - time.monotonic(), 0.001))
    return b"".join(parts).decode("utf-8", "replace")


def whois(domain: str, server: str = "whois.iana.org", port: int = 43) -> bool:
    """Whether one `domain` is registered, asked from here; the server may refer to another. For many, see `lookups`."""
    for _ in range(HOPS):
        text = said(domain, server, port).lower()
        refer = [line.split(":", 1)[1].strip() for line in text.splitlines() if line.startswith("refer:")]
        if not refer:
            return bool(text.strip()) and not any(x in text for x in UNREGISTERED)
        server = refer[0]
    return True


def look_up(domain: str, server: str, pause: Callable[[], None], port: int = 43, timeout: float = TIMEOUT_S) -> tuple:
    """A row of LOOKUPS. Begun again after a failure, TRIES times in all; `pause` waits for the server's turn before each."""
    for tries in range(1, TRIES + 1):
        pause()
        try:
            text = said(domain, server, port, timeout)
        except UnicodeError:  # no such name can be registered
            return domain, server, "failed", tries, None
        except OSError as error:
            status = "timeout" if isinstance(error, TimeoutError) else "refused" if isinstance(error, ConnectionRefusedError) else "failed"
        else:
            if text.strip():
                return domain, server, "answered", tries, text
            status = "silent"
    return domain, server, status, TRIES, None


class Lane:
    """Questions to one server, one at a time, `pace` seconds apart."""

    def __init__(self) -> None:
        self.next = 0.0

    def run(self, rows: list[tuple], port: int, timeout: float) -> list[tuple]:
        def pause() -> None:
            time.sleep(max(self.next - time.monotonic(), 0))
            self.next = time.monotonic() + pace

        out = []
        for domain, server, pace in rows:
            out.append(look_up(domain, server, pause, port, timeout))
        return out


def _by_server(questions: DataFrame, rate: float, port: int, timeout: float) -> DataFrame:
    """LOOKUPS of questions (domain, server). A server's questions go in lanes of PER_TASK, about, that share its rate."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lanes: dict[tuple, Lane] = {}
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for frame in frames:
                groups = [(key, list(zip(g.domain, g.server, g.pace))) for key, g in frame.groupby(["server", "lane"])]
                parts = pool.map(lambda x: lanes.setdefault(x[0], Lane()).run(x[1], port, timeout), groups)
                yield pd.DataFrame([r for rows in parts for r in rows], columns=[c.split()[0] for c in LOOKUPS.split(", ")]).astype({"tries": "int32"})

    questions = stored(questions.select("domain", "server"), "lookups")
    lanes = questions.groupBy("server").agg(F.ceil(F.count(F.lit(1)) / PER_TASK).alias("lanes"))
    spread = questions.join(lanes, "server").select("domain", "server", F.pmod(F.xxhash64("domain"), "lanes").alias("lane"), (F.col("lanes") / rate).alias("pace"))
    tasks = max(questions.sparkSession.sparkContext.defaultParallelism, -(-questions.count() // PER_TASK))
    return stored(spread.repartition(tasks, "server", "lane").mapInPandas(run, LOOKUPS), "looked-up")


def lookups(domains: DataFrame, servers: DataFrame | None = None, first: str = "whois.iana.org", rate: float = RATE, port: int = 43, timeout: float = TIMEOUT_S) -> DataFrame:
    """LOOKUPS of `domains` (domain), one row each: what the registry of the top-level name says, or why it says nothing.

    servers: (tld, server) known already; the server of any other top-level name is asked for at `first`, once for all names
    under it. Look-ups go to many servers at a time, to each at `rate` a second; a server that stalls or refuses holds up
    only its own. An answer that refers to another server is asked again there, HOPS times at most. Null names are left out.
    """
    refers = F.regexp_extract(F.coalesce("text", F.lit("")), r"(?im)^refer:[ \t]*(\S+)", 1)
    asked = stored(domains.select("domain").where("domain is not null").distinct().withColumn("tld", names.last_labels(names.labels(names.norm_host(F.col("domain"))), 1)), "domains")
    known = servers.select("tld", "server") if servers is not None else asked.select("tld", F.lit(None).cast("string").alias("server")).limit(0)
    unknown = asked.select("tld").where("tld is not null").distinct().join(known, "tld", "left_anti")
    told = _by_server(unknown.select(F.col("tld").alias("domain"), F.lit(first).alias("server")), rate, port, timeout)
    known = known.union(told.select(F.col("domain").alias("tld"), refers.alias("server")).where("server <> ''"))
    known = known.groupBy("tld").agg(F.min("server").alias("server"))
    routed = stored(asked.join(known, "tld", "left").select("domain", "server"), "routed")
    lost = routed.where("server is null").select("domain", "server", F.lit("no server").alias("status"), F.lit(0).alias("tries"), F.lit(None).cast("string").alias("text"))
    done, going = lost, routed.where("server is not null")
    for hop in range(HOPS):
        got = _by_server(going, rate, port, timeout).withColumn("to", refers)
        on = F.lit(hop + 1 < HOPS) & (F.col("to") != "") & (F.col("to") != F.col("server"))
        done, going = done.union(got.where(~on).drop("to")), got.where(on).select("domain", F.col("to").alias("server"))
        if going.isEmpty():
            break
    return done
