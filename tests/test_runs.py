import json
import random
import socket
import struct
import threading
import time

import pytest
from pyspark.sql import functions as F

from tests import world
from zonewalk.operators import analysis, fetch
from zonewalk.plans import batch
from zonewalk.plans.closure import reachable
from zonewalk.plans.components import on_cycles, strong_parts
from zonewalk.sources import live, readers, table
from zonewalk.streaming.hosts import crawl_stream, host_stream


def frame(spark, values, schema="query string"):
    return spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema)


def test_a_step_is_run_once_a_pass(spark, tmp_path):
    """Each run of the step fails other hosts, as a live network may; no host is lost or reported twice."""
    def step(hosts):
        def mark(rows):
            for r in rows:
                yield (r.query, random.random() < 0.5)

        tried = spark.createDataFrame(hosts.rdd.mapPartitions(mark), "query string, good boolean")
        return tried.where("good").select("query")

    left = batch.crawl(spark, frame(spark, [f"h{i}" for i in range(40)]), str(tmp_path), step, passes=1)
    done = [r.query for r in readers.read_reports(spark, f"{tmp_path}/reports").collect()]
    assert sorted(done + [r.query for r in left.collect()]) == sorted(f"h{i}" for i in range(40))


def test_cycles_between_long_chains(spark):
    edges = [(f"c{i}", f"c{i + 1}") for i in range(12)] + [("c12", "x"), ("x", "y"), ("y", "x"), ("y", "d0")] + [(f"d{i}", f"d{i + 1}") for i in range(5)] + [("s", "s")]
    assert {r.src for r in on_cycles(frame(spark, edges, "src string, dst string")).collect()} == {"x", "y", "s"}
    assert on_cycles(frame(spark, edges[:5], "src string, dst string")).count() == 0


def test_closure_of_a_cyclic_graph(spark):
    edges = frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", None)], "src string, dst string")
    assert reachable(edges).count() == 12
    assert {r.src for r in on_cycles(edges).collect()} == {"a", "b", "c"}
    assert {r.dst for r in reachable(edges, frame(spark, ["d"], "src string")).collect()} == set()


def test_strong_parts_as_by_brute_force(spark):
    """Sparse and dense graphs, with names on themselves, repeated edges and nulls; dense ones are coloured."""
    rng, edges = random.Random(5), set()
    for g in range(60):
        n = rng.randrange(2, 14)
        edges |= {(f"g{g}.{rng.randrange(n)}", f"g{g}.{rng.randrange(n)}") for _ in range(rng.randrange(1, 4 * n))}
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
        to.setdefault(b, set())

    def reach(v):
        seen, open_ = set(), [v]
        while open_:
            more = to[open_.pop()] - seen
            seen |= more
            open_ += more
        return seen

    far = {v: reach(v) for v in to}
    given = frame(spark, [*sorted(edges), *sorted(edges)[:9], ("g0.0", None), (None, "g0.0")], "src string, dst string")
    assert {r.name: r.part for r in strong_parts(given).collect()} == {v: min([v, *(w for w in far[v] if v in far[w])]) for v in to}
    assert {r.src for r in on_cycles(given).collect()} == {v for v in to if v in far[v]}
    assert strong_parts(given.limit(0)).count() == 0


def test_a_ring_of_many_names_is_one_part(spark):
    n = 100_000
    ring = spark.range(n).selectExpr("concat('r', id) AS src", f"concat('r', (id + 1) % {n}) AS dst")
    tail = frame(spark, [("t", "r5"), ("r7", "u")], "src string, dst string")
    got = strong_parts(ring.union(tail)).groupBy("part").count().collect()
    assert {(r.part, r["count"]) for r in got} == {("r0", n), ("t", 1), ("u", 1)}


def test_batch_resumes_and_retries(spark, tmp_path):
    tried = []

    def step(hosts):
        names = sorted(r.query for r in hosts.collect())
        tried.append(names)
        bad = [n for n in names if n.startswith("bad") or (n == "late" and len(tried) == 1)]
        return spark.createDataFrame([(n, None, None, [f"ns.{n}"], *[None] * 9) for n in names if n not in bad], readers.REPORT)

    hosts = frame(spark, ["a", "b", "late", "bad", "a"])
    assert [r.query for r in batch.crawl(spark, hosts, str(tmp_path), step).collect()] == ["bad"]
    assert tried == [["a", "b", "bad", "late"], ["bad", "late"]]
    assert {r.query for r in readers.read_reports(spark, f"{tmp_path}/reports").collect()} == {"a", "b", "late"}
    batch.crawl(spark, frame(spark, ["a", "c"]), str(tmp_path), step)
    assert tried[2] == ["c"]
    readers.compile_reports(spark, f"{tmp_path}/reports", f"{tmp_path}/all.jsonl")
    lines = (tmp_path / "all.jsonl").read_text().splitlines()
    assert len(lines) == 4 and {json.loads(x)["query"] for x in lines} == {"a", "b", "c", "late"}
    assert readers.read_reports(spark, f"{tmp_path}/all.jsonl").count() == 4
    assert spark.read.text(f"{tmp_path}/retry").count() == 3


def test_hosts_over_their_time_are_tried_again_with_what_was_answered(spark, tmp_path):
    """gone.com. takes 20 of 10 seconds in the first pass, and none in the second, which has its answer."""
    asked, answers = [], fetch.table_port(world.responses(spark).withColumn("elapsed", F.expr("if(domain = 'gone.com.', 20D, 1D)")))

    def port(questions):
        asked.extend(r.domain for r in questions.collect())
        return answers(questions)

    suffixes, roots = frame(spark, world.SUFFIXES, "suffix string"), frame(spark, world.ROOTS, "ns string, ip string")
    left = batch.crawl(spark, frame(spark, ["ok.com.", "gone.com."], "query string"), str(tmp_path), batch.reporting(port, suffixes, roots, 10.0))
    assert left.isEmpty() and asked.count("gone.com.") == 1
    assert [r.value for r in spark.read.text(f"{tmp_path}/retry").collect()] == ["gone.com."]
    reports = {r.query: r for r in readers.read_reports(spark, f"{tmp_path}/reports").collect()}
    assert set(reports) == {"ok.com.", "gone.com."} and reports["ok.com."].ns == ["ns1.ok.com.", "ns2.ok.com."]
    assert list(reports["gone.com."].hazardous_domains) == ["gone.com."]


def test_readers(spark, tmp_path):
    (tmp_path / "hosts").write_text("a.com\n\nB.com.\n")
    assert [r.query for r in readers.read_hosts(spark, str(tmp_path / "hosts")).collect()] == ["a.com", "B.com."]
    (tmp_path / "rules").write_text("// note\n\ncom\n*.ck  x\n")
    assert [r.suffix for r in readers.read_suffixes(spark, str(tmp_path / "rules")).collect()] == ["com", "*.ck"]
    rows = frame(spark, [("a", [1, 2]), (None, None)], "k string, v array<int>")
    assert sorted(map(str, readers.json_round_trip(rows).collect())) == sorted(map(str, rows.collect()))


def test_exemptions(spark):
    rows = frame(spark, ["a.com.", "b.gov.", "c.us.", "d.com."], "name string")
    assert [r.name for r in analysis.without_exempt(rows, "name", frame(spark, ["d.com."], "name string"), analysis.EXEMPT_TLDS).collect()] == ["a.com."]
    assert analysis.without_exempt(rows, "name", frame(spark, ["d.com."], "name string")).count() == 3


def test_stream_writes_each_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("a\nb\na\n")
    run = crawl_stream(host_stream(spark, str(tmp_path / "in")), lambda x: x, str(tmp_path / "out"), str(tmp_path / "mark"))
    run.awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).select("query").count() == 2


def test_dns_message_round_trip():
    asked = live.question("ns.a.com.", "A", 7)
    assert asked[:2] == b"\0\7" and b"\2ns\1a\3com\0" in asked
    record = b"\xc0\x0c" + struct.pack(">2HIH", 1, 1, 60, 4) + socket.inet_aton("10.0.0.1")
    other = b"\xc0\x0c" + struct.pack(">2HIH", 2, 1, 60, 5) + b"\2ns\xc0\x0f"
    data = asked[:2] + struct.pack(">5H", 0x8400, 1, 1, 1, 0) + asked[12:] + record + other
    assert live.answer(data) == (0, ["ns.a.com. 60 IN A 10.0.0.1", "ns.a.com. 60 IN NS ns.a.com."])
    with pytest.raises(ValueError):
        live._name(b"\xc0\x00", 0)


def serve(replies):
    """A name server on a local port that sends, for each datagram, what `replies` gives."""
    link = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    link.bind(("127.0.0.1", 0))

    def run():
        while True:
            try:
                data, who = link.recvfrom(4096)
            except OSError:
                return
            for reply in replies(data):
                link.sendto(reply, who)

    threading.Thread(target=run, daemon=True).start()
    return link, link.getsockname()[1]


def test_replies_to_other_questions_are_passed_over():
    record = b"\xc0\x0c" + struct.pack(">2HIH", 1, 1, 60, 4) + socket.inet_aton("10.0.0.1")

    def reply(asked, number):
        return number + struct.pack(">5H", 0x8403, 1, 1, 0, 0) + asked[12:] + record

    link, port = serve(lambda asked: [reply(asked, bytes([asked[0] ^ 1, asked[1]])), asked, reply(asked, asked[:2])])
    rows = live.ask("a.com.", "127.0.0.1", [live._direct], port)
    assert rows == [("a.com.", "127.0.0.1", 3, 3, 3, False, i, "a.com. 60 IN A 10.0.0.1") for i in range(3)]
    link.close()


def test_recorded_answers_are_read_by_name(spark, tmp_path):
    rows = world.responses(spark).withColumns({c: F.lit(None).cast("int") for c in fetch.CODES[1:3]})
    table.write_responses(rows, str(tmp_path / "recorded"))
    said = lambda **named: table.dns_responses(spark, str(tmp_path / "recorded"), **named)
    columns = ["domain", "nameserver", "rcode", "timeout", "seq", "rr_text"]
    flat = lambda df: sorted(map(str, df.select(*columns).collect()))
    every, of_com, of_two = said(), said(nameservers=[world.COM]), said(nameservers=[world.COM, world.UK])
    assert flat(every) == flat(rows)
    assert flat(of_com) == flat(rows.where(f"nameserver = '{world.COM}'"))
    assert flat(of_two.where("domain <> 'ok.com.'")) == flat(rows.where(f"nameserver in ('{world.COM}', '{world.UK}') and domain <> 'ok.com.'"))
    assert flat(said(domains=["ok.com."], nameservers=["10.1.0.2"])) == flat(rows.where("domain = 'ok.com.' and nameserver = '10.1.0.2'"))
    assert flat(said(types=["AAAA"])) == flat(rows.where("rr_text like '% IN AAAA %'"))
    assert said(nameservers=["none"]).isEmpty() and said(domains=[]).isEmpty()
    assert flat(of_com.union(every).union(of_two.where("type = 'NS'"))) == sorted(flat(of_com) + flat(every) + flat(of_two.where("type = 'NS'")))
    assert of_com.rdd.getNumPartitions() < every.rdd.getNumPartitions()


def test_servers_are_asked_for_what_is_named(spark):
    record = b"\xc0\x0c" + struct.pack(">2HIH", 1, 1, 60, 4) + socket.inet_aton("10.0.0.1")
    asked = []

    def replies(data):
        asked.append(data[12:-4])
        return [data[:2] + struct.pack(">5H", 0x8400, 1, 1, 0, 0) + data[12:] + record]

    link, port = serve(replies)
    got = table.dns_responses(spark, domains=["a.com.", "b.com."], nameservers=["127.0.0.1"], types=["A"], port=port).collect()
    assert sorted((r.domain, r.seq, r.rr_text) for r in got) == [(f"{x}.com.", i, f"{x}.com. 60 IN A 10.0.0.1") for x in "ab" for i in range(3)]
    assert len(asked) == 6 and all(r.elapsed > 0 and not r.timeout for r in got)
    with pytest.raises(Exception, match="must be named"):
        table.dns_responses(spark, domains=["a.com."]).collect()
    link.close()


def test_ask_gives_a_timeout_row_after_all_tries(monkeypatch):
    monkeypatch.setattr(live, "TIMEOUT_S", 0.05)
    assert live.ask("a.com.", "127.0.0.1", [live._direct]) == [("a.com.", "127.0.0.1", None, None, None, True, 0, None)]
    tries = iter(range(99))
    link, port = serve(lambda asked: [asked[:2] + struct.pack(">5H", 0x8400, 1, 0, 0, 0) + asked[12:]] if next(tries) % 2 == 0 else [])
    assert live.ask("a.com.", "127.0.0.1", [live._direct], port) == [("a.com.", "127.0.0.1", 0, None, None, True, 0, None)]
    link.close()


def test_fetch_asks_each_question_once(spark):
    got = live.fetch(frame(spark, [("a.com.", "127.0.0.1"), ("a.com.", "127.0.0.1"), ("b.com.", "127.0.0.1")], "domain string, nameserver string"), [lambda: 1 / 0 if False else live._direct()])
    assert got.columns == [c.split()[0] for c in readers.RESPONSES.split(", ")]


def test_fetch_tells_the_time_of_each_answer(spark):
    got = live.fetch(frame(spark, [("a.com.", "127.0.0.1")], "domain string, nameserver string"), timed=True)
    assert [f.name for f in got.schema] == [c.split()[0] for c in readers.TIMED.split(", ")]
    assert all(r.elapsed >= 0 for r in got.collect())


def test_whois_lookup():
    link = socket.create_server(("127.0.0.1", 0))

    def run():
        for _ in range(2):
            own, _ = link.accept()
            asked = own.recv(100)
            own.sendall(b"No match for domain\r\n" if asked.startswith(b"free") else b"Domain Name: TAKEN.COM\r\n")
            own.close()

    threading.Thread(target=run, daemon=True).start()
    port = link.getsockname()[1]
    assert not live.whois("free.com.", "127.0.0.1", port) and live.whois("taken.com", "127.0.0.1", port)
    link.close()


def registry(host, port, reply):
    """A registration server; it answers as `reply` says, or not at all where that gives None. Gives the port and what was asked."""
    link, asked = socket.create_server((host, port)), []

    def run():
        held = []
        while True:
            own, _ = link.accept()
            asked.append(own.recv(100).decode().strip())
            text = reply(asked[-1])
            if text is None:
                held.append(own)
                continue
            own.sendall(text.encode())
            own.close()

    threading.Thread(target=run, daemon=True).start()
    return link.getsockname()[1], asked


def test_lookups_go_by_server_and_lose_no_row(spark):
    """127.0.0.2 answers, .3 stalls, nobody listens at .4, .5 sends on to .2, .6 says nothing the first time; .1 knows the registries."""
    at = {"good": 2, "slow": 3, "gone": 4, "far": 5, "late": 6}
    port, first = registry("127.0.0.1", 0, lambda tld: f"domain: {tld}\nrefer:  127.0.0.{at[tld]}\n" if tld in at else "nothing here\n")
    _, good = registry("127.0.0.2", port, lambda d: "No match for it\n" if d.startswith("free") else "Domain Name: TAKEN\n")
    registry("127.0.0.3", port, lambda d: None)
    registry("127.0.0.5", port, lambda d: "refer: 127.0.0.2\n")
    turns = iter([""] + ["Domain Name: TAKEN\n"] * 9)
    registry("127.0.0.6", port, lambda d: next(turns))
    asked = ["free.good.", "a.good.", "b.good.", "a.good.", "a.slow.", "a.gone.", "free.far.", "a.late.", "a.nowhere.", "x" * 70 + ".good.", None]
    got = {r.domain: r for r in analysis.registration(live.lookups(frame(spark, asked, "domain string"), first="127.0.0.1", rate=50.0, port=port, timeout=0.4)).collect()}
    assert {d: (r.status, r.tries, r.registered) for d, r in got.items()} == {
        "free.good.": ("answered", 1, False), "a.good.": ("answered", 1, True), "b.good.": ("answered", 1, True),
        "a.slow.": ("timeout", live.TRIES, None), "a.gone.": ("refused", live.TRIES, None), "free.far.": ("answered", 1, False),
        "a.late.": ("answered", 2, True), "a.nowhere.": ("no server", 0, None), "x" * 70 + ".good.": ("failed", 1, None),
    }
    assert sorted(first) == ["far", "gone", "good", "late", "nowhere", "slow"] and sorted(good) == ["a.good", "b.good", "free.far", "free.good"]
    given = live.lookups(frame(spark, ["a.good."], "domain string"), frame(spark, [("good.", "127.0.0.2")], "tld string, server string"), first="127.0.0.9", port=port)
    assert [(r.server, r.status) for r in given.collect()] == [("127.0.0.2", "answered")] and len(first) == 6


def test_a_server_is_asked_at_its_rate():
    port, _ = registry("127.0.0.1", 0, lambda d: "Domain Name: TAKEN\n")
    began = time.monotonic()
    rows = live.Lane().run([(f"d{i}.com.", "127.0.0.1", 0.1) for i in range(6)], port, 1.0)
    assert time.monotonic() - began >= 0.5 and [r[2] for r in rows] == ["answered"] * 6


def proxy(login=None):
    """A SOCKS version 5 proxy that relays datagrams and streams; gives its port and the commands that it was given."""
    link, commands = socket.create_server(("127.0.0.1", 0)), []

    def pump(a, b):
        while data := a.recv(65536):
            b.sendall(data)
        b.shutdown(socket.SHUT_WR)

    def relay(own):
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as inner, socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as outer:
            inner.bind(("127.0.0.1", 0))
            own.sendall(b"\5\0\0\1" + bytes(4) + struct.pack(">H", inner.getsockname()[1]))
            data, client = inner.recvfrom(65536)
            outer.sendto(data[10:], (socket.inet_ntoa(data[4:8]), struct.unpack(">H", data[8:10])[0]))
            reply, _ = outer.recvfrom(65536)
            other = bytes(3) + b"\1" + bytes([9, 9, 9, 9]) + data[8:10]
            for head in (other, b"\0\0\1" + data[3:10], data[:10]):  # of another server, a piece, and the reply
                inner.sendto(head + reply, client)

    def serve_one(own):
        own.recv(own.recv(2)[1])
        if login:
            own.sendall(b"\5\2")
            own.recv(1)
            name = own.recv(own.recv(1)[0])
            word = own.recv(own.recv(1)[0])
            own.sendall(b"\1" + bytes([(name, word) != login]))
        else:
            own.sendall(b"\5\0")
        head = own.recv(10)
        if len(head) < 10:
            return
        commands.append(head[1])
        if head[1] == 3:
            relay(own)
        else:
            far = socket.create_connection((socket.inet_ntoa(head[4:8]), struct.unpack(">H", head[8:10])[0]))
            own.sendall(b"\5\0\0\1" + bytes(6))
            threading.Thread(target=pump, args=(own, far), daemon=True).start()
            pump(far, own)
        own.close()

    def run():
        while True:
            own, _ = link.accept()
            threading.Thread(target=serve_one, args=(own,), daemon=True).start()

    threading.Thread(target=run, daemon=True).start()
    return link.getsockname()[1], commands


def test_questions_go_through_a_proxy(monkeypatch):
    record = b"\xc0\x0c" + struct.pack(">2HIH", 1, 1, 60, 4) + socket.inet_aton("10.0.0.1")
    link, port = serve(lambda asked: [asked[:2] + struct.pack(">5H", 0x8400, 1, 1, 0, 0) + asked[12:] + record])
    at, commands = proxy()
    assert live.ask("a.com.", "127.0.0.1", [live.relay("127.0.0.1", at)], port) == [("a.com.", "127.0.0.1", 0, 0, 0, False, i, "a.com. 60 IN A 10.0.0.1") for i in range(3)]
    assert commands == [3, 3, 3]
    at, commands = proxy(login=(b"me", b"word"))
    assert len(live.ask("a.com.", "127.0.0.1", [live.relay("127.0.0.1", at, "me", "word")], port)) == 3
    assert live.ask("a.com.", "127.0.0.1", [live.relay("127.0.0.1", at, "me", "wrong")], port)[0][5] and commands == [3, 3, 3]
    link.close()


def test_cut_replies_are_fetched_through_the_proxy():
    record = b"\xc0\x0c" + struct.pack(">2HIH", 1, 1, 60, 4) + socket.inet_aton("10.0.0.1")
    link, port = serve(lambda asked: [asked[:2] + struct.pack(">5H", 0x8600, 1, 0, 0, 0) + asked[12:]])
    whole = socket.create_server(("127.0.0.1", port))

    def run():
        while True:
            own, _ = whole.accept()
            asked = own.recv(4096)[2:]
            reply = asked[:2] + struct.pack(">5H", 0x8400, 1, 1, 0, 0) + asked[12:] + record
            own.sendall(struct.pack(">H", len(reply)) + reply)
            own.close()

    threading.Thread(target=run, daemon=True).start()
    at, commands = proxy()
    rows = live.ask("a.com.", "127.0.0.1", [live.relay("127.0.0.1", at)], port)
    assert [r[7] for r in rows] == ["a.com. 60 IN A 10.0.0.1"] * 3 and commands == [3, 1] * 3
    link.close()
