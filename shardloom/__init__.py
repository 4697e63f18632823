"""shardloom: sharded analytics on Spark."""
