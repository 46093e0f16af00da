"""A small recorded DNS world, one host per behaviour."""

ROOT, COM, UK, NICUK, OK = "198.41.0.4", "10.0.0.1", "10.0.1.1", "10.0.1.2", "10.1.0.1"
SUFFIXES = [("com.",), ("uk.",), ("co.uk.",)]
ROOTS = [("a.root-servers.net.", ROOT), ("b.root-servers.net.", "199.9.14.201")]
NX = 3


def ns(zone, *servers):
    return [f"{zone} 3600 IN NS {s}" for s in servers]


def a(host, ip, kind="A"):
    return f"{host} 60 IN {kind} {ip}"


COM_ANSWER = [*ns("com.", "a.gtld.com."), a("a.gtld.com.", COM)]
OK_ANSWER = [*ns("ok.com.", "ns1.ok.com.", "NS2.ok.com."), a("ns1.ok.com.", OK), a("NS2.ok.com.", "10.1.0.2"), a("ns2.ok.com.", "2001:db8::2", "AAAA")]
#: (domain, server): lines, or an rcode, or "timeout".
ANSWERS = {
    ("com.", ROOT): COM_ANSWER, ("com.", COM): COM_ANSWER,
    ("uk.", ROOT): [*ns("uk.", "ns.nic.uk."), a("ns.nic.uk.", UK)], ("uk.", UK): [*ns("uk.", "ns.nic.uk."), a("ns.nic.uk.", UK)],
    ("co.uk.", UK): [*ns("co.uk.", "dns1.nic.uk."), a("dns1.nic.uk.", NICUK)], ("co.uk.", NICUK): [*ns("co.uk.", "dns1.nic.uk."), a("dns1.nic.uk.", NICUK)],
    ("a.co.uk.", NICUK): [*ns("a.co.uk.", "ns1.a.co.uk."), a("ns1.a.co.uk.", "10.2.0.1")], ("a.co.uk.", "10.2.0.1"): [*ns("a.co.uk.", "ns1.a.co.uk."), a("ns1.a.co.uk.", "10.2.0.1")],
    ("ok.com.", COM): OK_ANSWER, **{("ok.com.", ip): OK_ANSWER for ip in (OK, "10.1.0.2", "2001:db8::2")},
    **{("host.ok.com.", ip): [a("host.ok.com.", "10.1.0.9")] for ip in (OK, "10.1.0.2", "2001:db8::2", "10.1.0.9")},
    **{("ns1.ok.com.", ip): [a("ns1.ok.com.", OK)] for ip in (OK, "10.1.0.2", "2001:db8::2")},
    ("ext.com.", COM): ns("ext.com.", "ns1.deep.com."), ("ext.com.", "10.3.0.1"): ns("ext.com.", "ns1.deep.com."),
    ("deep.com.", COM): [*ns("deep.com.", "x.deep.com."), a("x.deep.com.", "10.3.0.2")], ("deep.com.", "10.3.0.2"): [*ns("deep.com.", "x.deep.com."), a("x.deep.com.", "10.3.0.2")],
    ("ns1.deep.com.", "10.3.0.2"): [a("ns1.deep.com.", "10.3.0.1")], ("ns1.deep.com.", "10.3.0.1"): [a("ns1.deep.com.", "10.3.0.1")],
    ("gone.com.", COM): NX,
    ("dangling.com.", COM): ns("dangling.com.", "ns.gone.com."),
    ("ipns.com.", COM): ns("ipns.com.", "10.0.0.9."), ("9.", ROOT): NX,
    ("lame.com.", COM): [*ns("lame.com.", "ns.lame.com."), a("ns.lame.com.", "10.4.0.1")], ("lame.com.", "10.4.0.1"): NX,
    ("slow.com.", COM): [*ns("slow.com.", "ns.slow.com."), a("ns.slow.com.", "10.5.0.1")], ("slow.com.", "10.5.0.1"): "timeout",
    ("x.com.", COM): [*ns("x.com.", "ns.x.com."), a("ns.x.com.", "10.6.0.1")], ("x.com.", "10.6.0.1"): [*ns("x.com.", "ns.x.com."), a("ns.x.com.", "10.6.0.1")],
    ("ent.x.com.", "10.6.0.1"): 0,
    ("a.ent.x.com.", "10.6.0.1"): [*ns("a.ent.x.com.", "ns.a.ent.x.com."), a("ns.a.ent.x.com.", "10.6.0.7")], ("a.ent.x.com.", "10.6.0.7"): [*ns("a.ent.x.com.", "ns.a.ent.x.com."), a("ns.a.ent.x.com.", "10.6.0.7")],
    ("p.com.", COM): ns("p.com.", "ns.q.com."), ("q.com.", COM): ns("q.com.", "ns.p.com."),
    ("ent.x.com.", "10.6.0.7"): 0,
}
SCHEMA = "domain string, nameserver string, rcode int, timeout boolean, seq int, rr_text string"


def responses(spark):
    rows = []
    for (domain, server), answer in ANSWERS.items():
        if answer == "timeout":
            rows.append((domain, server, None, True, 0, None))
        elif isinstance(answer, int):
            rows.append((domain, server, answer, False, 0, None))
        else:
            rows += [(domain, server, 0, False, i, line) for i, line in enumerate(answer)]
    return spark.createDataFrame(rows, SCHEMA)


HOSTS = ["ok.com.", "Ok.COM", "ext.com.", "a.co.uk.", "gone.com.", "www.gone.com.", "dangling.com.", "ipns.com.", "lame.com.", "slow.com.", "ent.x.com.", "a.ent.x.com.", "p.com.", "q.com.", "host.ok.com.", ".", ""]
