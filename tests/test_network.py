import ipaddress

from pyspark.sql import functions as F

from watchtrail.functions.network import address_number, cidr_ranges, in_ranges
from watchtrail.operators.features import external_ip

BLOCKS = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "fc00::/7", "::1/128", "fe80::/10"]
VALUES = [
    "10.1.2.3", "172.15.255.255", "172.16.0.0", "172.31.255.255", "172.32.0.0", "8.8.8.8", "fd12:3456::1", "fe80::1%eth0",
    "2001:db8::1", "::1", "::ffff:10.0.0.1", "::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "not-an-ip", "10.0.1.3000",
    None, "FD00::abcd", "1:2:3:4:5:6:7:8", "fe7f:ffff::", "febf:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "fec0::",
]


def truth(value):
    try:
        address = ipaddress.ip_address((value or "").split("%")[0])
    except ValueError:
        return None
    return any(address in net for net in map(ipaddress.ip_network, BLOCKS) if net.version == address.version)


def test_ranges_equal_python_addresses(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v string").withColumn("n", address_number(F.col("v")))
    got = {r.v: r.inside for r in df.select("v", in_ranges(F.col("n"), cidr_ranges(BLOCKS)).alias("inside")).collect()}
    assert got == {v: truth(v) for v in VALUES}


def test_ranges_merge_and_keep_unsigned_order():
    merged = cidr_ranges(["10.0.0.0/9", "10.128.0.0/9", "10.1.0.0/16", "ffff::/16", "::/1"])
    assert [r[0] for r in merged] == [4, 6, 6] and len(merged) == 3
    assert merged[1][1] < merged[2][1]


def test_external_ip_with_blocks_keeps_columns(spark):
    df = spark.createDataFrame([("10.9.9.9", 1), ("fd00::1", 2), ("2001:db8::5", 3), ("x", 4)], "source_ip string, _address int")
    found = {r._address: r.external_ip for r in external_ip(df, cidrs=BLOCKS).collect()}
    assert found == {1: 0, 2: 0, 3: 1, 4: 1}
