"""What is stateless runs on a stream as it is; here is the state that can be merged."""
