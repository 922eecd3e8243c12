"""skein: Spark-native analytics over archives of posts, chats and event logs."""

__version__ = "0.1.0"
