"""sensortwin: Spark-native analytics for factory sensor events.

bronze -> silver -> gold (equipment 5-minute metrics, batch yield, hourly
sustainability) and the serving questions asked of them, as DataFrame functions that
work the same in batch and in Structured Streaming.
"""

__version__ = "0.1.0"
