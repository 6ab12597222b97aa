"""packetloom: network-traffic analytics as composable Spark DataFrame and streaming operators."""
