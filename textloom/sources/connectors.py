"""Options of connectors whose jars a cluster may bring; the frames come from Spark's own reader and writer."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class MongoSettings:
    host: str
    database: str
    port: int = 27017
    user: str | None = None
    password: str | None = None
    auth_source: str | None = None

    def uri(self, collection: str) -> str:
        """Credentials only where both parts are there, escaped."""
        login = f"{quote(self.user, safe='')}:{quote(self.password, safe='')}@" if self.user and self.password else ""
        query = f"?authSource={quote(self.auth_source)}" if login and self.auth_source else ""
        return f"mongodb://{login}{self.host}:{self.port}/{self.database}.{collection}{query}"

    def options(self, collection: str) -> dict[str, str]:
        return {"connection.uri": self.uri(collection), "database": self.database, "collection": collection}


def load_collection(spark: SparkSession, settings: MongoSettings, collection: str) -> DataFrame:
    return spark.read.format("mongodb").options(**settings.options(collection)).load()


def save_collection(df: DataFrame, settings: MongoSettings, collection: str, mode: str = "overwrite") -> None:
    df.write.format("mongodb").options(**settings.options(collection)).mode(mode).save()


def cassandra_options(host: str, user: str | None = None, password: str | None = None) -> dict[str, str]:
    found = {"spark.cassandra.connection.host": host}
    return found | ({"spark.cassandra.auth.username": user, "spark.cassandra.auth.password": password} if user and password else {})


def elasticsearch_options(nodes: str, port: int = 9200) -> dict[str, str]:
    return {"es.nodes": nodes, "es.port": str(port), "es.index.auto.create": "true"}


def kafka_read_options(brokers: str, topic: str, starting: str = "earliest", stream: bool = True) -> dict[str, str]:
    found = {"kafka.bootstrap.servers": brokers, "subscribe": topic, "startingOffsets": starting}
    return found | ({"failOnDataLoss": "false"} if stream else {})


def kafka_write_options(brokers: str, topic: str, checkpoint: str | None = None) -> dict[str, str]:
    found = {"kafka.bootstrap.servers": brokers, "topic": topic}
    return found | ({"checkpointLocation": checkpoint} if checkpoint else {})
