"""What a socket on the driver receives, as a stream: ``format("udp")`` and ``format("live")``.

``register(spark)`` first. The driver keeps what isn't committed yet, so this suits what one machine
can take; a larger flow goes through a relay to files or Kafka. Nothing asks a sender to send
again: what was not committed is gone with the driver.

- ``udp``: the lines of datagrams, such as syslog ones. Options ``host``, ``port`` (0: any free one).
- ``live``: packets of a network interface, by a raw socket (Linux, and the right to open one). Options
  ``interface`` (all, if not given). Columns are those of ``format("pcap")``.
"""

from __future__ import annotations

import socket
import threading
import time
from collections import deque
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from .packets import dissect
from .pcap_format import COLUMNS

MAX_DATAGRAM = 65_535
BUFFER = 1 << 22
#: All protocols, in the number by which Linux's raw sockets ask for them.
ETH_P_ALL = 0x0003


class ReceivedReader(SimpleDataSourceStreamReader):
    """Rows that a thread receives, numbered from zero; an offset is a number of rows."""

    def __init__(self, options: dict) -> None:
        self.options = dict(options)
        self.rows: deque[tuple[int, tuple]] = deque()
        self.received = 0
        self.lock = threading.Lock()
        self.socket: socket.socket | None = None

    def __reduce__(self):
        """A copy elsewhere has the options alone; rows and socket stay with the driver's reader."""
        return type(self), (self.options,)

    def open(self) -> socket.socket:
        raise NotImplementedError

    def rows_of(self, data: bytes) -> Iterator[tuple]:
        raise NotImplementedError

    def listen(self) -> socket.socket:
        """Opens the socket, once."""
        if self.socket is None:
            self.socket = self.open()
            threading.Thread(target=self._receive, daemon=True).start()
        return self.socket

    def _receive(self) -> None:
        while True:
            rows = list(self.rows_of(self.socket.recv(MAX_DATAGRAM)))
            with self.lock:
                self.rows.extend(enumerate(rows, self.received))
                self.received += len(rows)

    def initialOffset(self) -> dict:
        self.listen()
        return {"row": 0}

    def _between(self, start: int, end: int) -> list[tuple]:
        return [row for n, row in self.rows if start <= n < end]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        self.listen()
        with self.lock:
            # after a restart rows are counted from zero again
            at = min(start["row"], self.received)
            return iter(self._between(at, self.received)), {"row": self.received}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        with self.lock:
            return iter(self._between(start["row"], end["row"]))

    def commit(self, end: dict) -> None:
        with self.lock:
            while self.rows and self.rows[0][0] < end["row"]:
                self.rows.popleft()


class UdpReader(ReceivedReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.host, self.port = options.get("host", "0.0.0.0"), int(options.get("port", 0))

    def open(self) -> socket.socket:
        out = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        out.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, BUFFER)
        out.bind((self.host, self.port))
        return out

    def rows_of(self, data: bytes) -> Iterator[tuple]:
        for line in data.decode("utf-8", "replace").splitlines():
            yield (line,)


class LiveReader(ReceivedReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.interface = options.get("interface")

    def open(self) -> socket.socket:
        if not hasattr(socket, "AF_PACKET"):
            raise OSError("live capture needs Linux's raw sockets")
        out = socket.socket(socket.AF_PACKET, socket.SOCK_RAW, socket.htons(ETH_P_ALL))
        out.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, BUFFER)
        if self.interface:
            out.bind((self.interface, 0))
        return out

    def rows_of(self, data: bytes) -> Iterator[tuple]:
        ns = time.time_ns()
        fields = {"type": "network", "timestamp_ns": ns, "path": self.interface, "timestamp": ns / 1e9, "length": len(data), "captured_length": len(data), "interface": self.interface} | dissect(data)
        yield tuple(fields.get(name) for name, _ in COLUMNS)


class UdpDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "udp"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema: StructType) -> UdpReader:
        return UdpReader(self.options)


class LiveDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "live"

    def schema(self) -> str:
        return ", ".join(f"`{n}` {t}" for n, t in COLUMNS)

    def simpleStreamReader(self, schema: StructType) -> LiveReader:
        return LiveReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(UdpDataSource)
    spark.dataSource.register(LiveDataSource)
