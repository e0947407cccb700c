"""linkloom: a Spark-native engine for collections of saved links."""
