"""Settings, checked when made."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class WindowConfig:
    """Of the sliding-window job; times in seconds."""

    source: str = "validated-events"
    sink: str = "sliding-features"
    late: str = "sliding-features-late"
    skew: float = 5.0
    idle: float = 30.0
    lateness: float = 30.0
    workers: int = 1
    ttl_multiplier: float = 1.5
    first_watermark_ms: int | None = None  # a run's first; windows that end before its slide never fire

    def __post_init__(self):
        if len({self.source, self.sink, self.late}) < 3:
            raise ValueError("source, sink and late output must differ")
        if not 0 <= self.lateness < 300:
            raise ValueError("lateness must be under the smallest window, 300 s")
        if not 1 <= self.workers <= 12:
            raise ValueError("1 to 12 workers")
        if self.skew < 0 or self.idle <= 0 or self.ttl_multiplier < 1:
            raise ValueError("skew, idle time or TTL multiplier out of range")


@dataclass(frozen=True)
class ValidatorConfig:
    """Of the validation job."""

    source: str = "e-commerce-events"
    validated: str = "validated-events"
    dlq: str = "dead-letter-queue"
    batch: int = 500

    def __post_init__(self):
        if len({self.source, self.validated, self.dlq}) < 3:
            raise ValueError("source, validated and dead-letter outputs must differ")
        if self.batch < 1:
            raise ValueError("a batch holds at least one event")


@dataclass(frozen=True)
class KafkaConfig:
    """Where Kafka is reached; only turned into options (no connector is needed to do that)."""

    bootstrap: str = "localhost:9092"
    starting: str = "earliest"
    isolation: str = "read_uncommitted"
    max_per_trigger: int | None = None

    def source_options(self, topic: str, since_ms: int | None = None) -> dict[str, str]:
        """since_ms: a cold start reads from the first message of that time on (warm-up); where a
        partition has none, from its end."""
        out = {"kafka.bootstrap.servers": self.bootstrap, "subscribe": topic, "startingOffsets": self.starting, "kafka.isolation.level": self.isolation}
        if since_ms is not None:
            out |= {"startingTimestamp": str(since_ms), "startingOffsetsByTimestampStrategy": "latest"}
        return out | ({"maxOffsetsPerTrigger": str(self.max_per_trigger)} if self.max_per_trigger else {})

    def sliding_source(self, config: WindowConfig, now_ms: int, warm_up_s: int = 3600) -> dict[str, str]:
        """Of the sliding-window job: only what was committed, rewound by the warm-up, in batches of
        at most 500 messages unless told otherwise."""
        own = replace(self, starting="latest", isolation="read_committed", max_per_trigger=self.max_per_trigger or 500)
        return own.source_options(config.source, now_ms - warm_up_s * 1000)

    def validator_source(self, config: ValidatorConfig) -> dict[str, str]:
        """Of the validation job: its batch bounds what a trigger takes."""
        return replace(self, max_per_trigger=self.max_per_trigger or config.batch).source_options(config.source)

    def sink_options(self, topic: str, exactly_once: bool = False) -> dict[str, str]:
        """Producer settings; the exactly-once profile forces full acknowledgement."""
        tuned = {"kafka.linger.ms": "20", "kafka.batch.size": "2000000", "kafka.compression.type": "lz4"}
        safe = {"kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.max.in.flight.requests.per.connection": "5"}
        return {"kafka.bootstrap.servers": self.bootstrap, "topic": topic} | tuned | (safe if exactly_once else {"kafka.acks": "1"})
