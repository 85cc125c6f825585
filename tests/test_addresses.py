import pytest
from pyspark.sql import functions as F

from lexigrid.errors import ConfigError
from lexigrid.functions.addresses import address_class, check_endpoint, classify


@pytest.mark.parametrize(
    ("address", "kind"),
    [("8.8.8.8", "public"), ("127.0.0.1", "loopback"), ("169.254.1.1", "link_local"), ("224.0.0.1", "multicast"), ("0.0.0.0", "unspecified"), ("100.64.0.1", "shared"), ("10.1.1.1", "private"), ("240.0.0.1", "reserved"),
     ("::1", "loopback"), ("::ffff:127.0.0.1", "loopback"), ("2002:7f00:1::", "loopback"), ("fe80::1", "link_local"), ("fc00::1", "private"), ("2606:4700::1", "public"), ("x", "invalid"), (None, "invalid")],
)
def test_classes(address, kind):
    assert classify(address) == kind


def test_endpoints(spark):
    assert check_endpoint("https://api.example.com/v1/", ["8.8.8.8"]) == "https://api.example.com/v1"
    assert check_endpoint("http://localhost:11434", ["127.0.0.1"], local=True)
    for url, addresses in (("https://u:p@h", ["8.8.8.8"]), ("https://h?x=1", ["8.8.8.8"]), ("https://h", ["8.8.8.8", "10.0.0.1"]), ("https://h", []), ("ftp://h", ["8.8.8.8"])):
        with pytest.raises(ConfigError):
            check_endpoint(url, addresses)
    assert spark.createDataFrame([("10.0.0.1",)], "a string").select(address_class(F.col("a")).alias("c")).first().c == "private"
